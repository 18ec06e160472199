"""Clusters of undirected normals by k-means on the sphere, run by Spark over all rows.

One round is one sum over the rows: each goes to the center with the largest absolute dot product and adds its
normal, turned to that center's side. Only the sums, a few numbers for each net and center, become the next
centers, so a net may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles, grades
from . import rounds as by_rounds
from .tables import written

Center = tuple[float, float, float]
#: Rows that one task orders, on average.
_ORDERED = 1 << 19


def _best(n: angles.Vector, centers: Column) -> Column:
    """struct(similarity, -k) of the nearest entry of an array of struct(x, y, z)."""
    found = F.transform(centers, lambda c, k: F.struct(F.abs(n[0] * c["x"] + n[1] * c["y"] + n[2] * c["z"]).alias("similarity"), (-k).alias("minus_k")))
    return F.array_max(found)


def _thinned(rows: DataFrame, n: int) -> DataFrame:
    """rows with a hash __h of id, those of a net in one task: of a large net only the first by the hash, some times n, so no task orders all of one; many nets go to as many tasks as their rows need."""
    sizes = written(rows.groupBy("net").agg(F.count("*").alias("__n")), "net-sizes")
    kept = sizes.agg(F.sum(F.least(F.col("__n"), F.lit(4 * n)))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept // _ORDERED))
    hashed = rows.withColumn("__h", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    return hashed.join(sizes, "net").filter(F.col("__h") <= F.lit(float(1 << 40)) * 4 * n / F.col("__n")).drop("__n").repartition(tasks, "net")


def few_by_hash(rows: DataFrame, n: int) -> DataFrame:
    """Up to n rows of each net with their rank r by a hash of id."""
    w = Window.partitionBy("net").orderBy("__h", "id")
    return _thinned(rows, n).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("__h")


def starting_centers(rows: DataFrame, k: int, pool: int = 256) -> DataFrame:
    """(net, centers): k rows of each net, each the farthest from those before, out of `pool` rows by a hash.

    The pool only places the start; every round after it is over all rows. A net of fewer rows than k has as many centers; rows without a normal are none.
    """
    known = rows.select("net", "id", *(F.col(f"n{c}").cast("double").alias(c) for c in "xyz")).dropna(subset=["net", "x", "y", "z"])
    drawn = _thinned(known, pool).sortWithinPartitions("net", "__h", "id").select("net", "x", "y", "z")
    return by_rounds.farthest_first(drawn, k, pool)


def _placed(met: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    for step in steps:
        met = met.withColumns(step)
    return met


def lloyd_grid(rows: DataFrame, starts: dict[int, DataFrame], rounds: int, weight: str | None = None) -> dict[int, DataFrame]:
    """(net, centers) of several models after so many rounds over the rows, all by the same scans.

    A center without rows stays, as does one whose rows cancel out. weight names a column that weighs rows. Rounds of
    a net end where no center of it moves any more.
    """
    if not starts:
        return {}
    if not rounds:
        return {m: c.filter(F.size("centers") > 0) for m, c in starts.items()}
    return by_rounds.lloyd(rows, starts, rounds, weight)


def lloyd(rows: DataFrame, centers: DataFrame, rounds: int, weight: str | None = None) -> DataFrame:
    """(net, centers) after so many rounds. A center without rows stays."""
    return lloyd_grid(rows, {0: centers}, rounds, weight)[0] if rounds else centers


def seeded_centers(rows: DataFrame, k: int, tries: int = 20, pool: int = 1024, seed: int = 0) -> DataFrame:
    """(net, try, centers): `tries` starts of each net, by k-means++ and rounds of k-means over `pool` rows drawn by a hash.

    The first center is a row of the pool, each further one a row drawn with odds 1 - |cos| to the nearest before.
    The pool only places the starts: which of them is best, and where it moves, all rows say (restarted()).
    """
    drawn = few_by_hash(rows.select("net", "id", "nx", "ny", "nz"), pool)
    pooled = drawn.groupBy("net").agg(F.array_sort(F.collect_list(F.struct("r", "nx", "ny", "nz"))).alias("pool"))
    starts = pooled.withColumn("draws", F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: F.pmod(F.xxhash64("net", t, F.lit(seed)), F.lit(1 << 60))))

    def grown(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            out = []
            pools = [np.array([[p["nx"], p["ny"], p["nz"]] for p in listed]) for listed in pdf["pool"]]
            for net, t, draw, x in ((net, t, draw, x) for net, draws, x in zip(pdf["net"], pdf["draws"], pools) for t, draw in enumerate(draws)):
                rng = np.random.default_rng(int(draw))
                at = [int(rng.integers(len(x)))]
                while len(at) < min(k, len(x)):
                    odds = np.clip(1 - np.abs(x @ x[at].T).max(axis=1), 0, None)
                    odds[at] = 0
                    at.append(int(rng.choice(len(x), p=odds / odds.sum())) if odds.sum() > 1e-12 else next(i for i in range(len(x)) if i not in at))
                c = x[at]
                for _ in range(20):
                    dots = x @ c.T
                    own = np.abs(dots).argmax(axis=1)
                    turned = x * np.sign(dots[np.arange(len(x)), own] + 1e-300)[:, None]
                    sums = np.stack([turned[own == i].sum(axis=0) for i in range(len(c))])
                    length = np.linalg.norm(sums, axis=1, keepdims=True)
                    c = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), c)
                out.append((net, t, [{"x": a, "y": b, "z": d} for a, b, d in c]))
            yield pd.DataFrame(out, columns=["net", "try", "centers"])

    return starts.mapInPandas(grown, f"net {rows.schema['net'].dataType.simpleString()}, try int, centers array<struct<x: double, y: double, z: double>>")


def restarted(rows: DataFrame, k: int, tries: int = 20, rounds: int = 12, seed: int = 0) -> DataFrame:
    """(net, centers): k-means from the best of `tries` starts, the one whose sum of 1 - |cos| over all rows is least (the first of equals)."""
    starts = written(seeded_centers(rows, k, tries, seed=seed), "starts")
    met = rows.select("net", "nx", "ny", "nz").join(starts, "net")
    cost = met.groupBy("net", "try").agg(F.sum(1 - _best(angles.vector(), F.col("centers"))["similarity"]).alias("cost"))
    best = cost.groupBy("net").agg(F.min(F.struct("cost", "try")).alias("b")).select("net", F.col("b.try").alias("try"))
    return lloyd(rows, written(starts.join(best, ["net", "try"]).select("net", "centers"), "best-start"), rounds)


def anchored(rows: DataFrame, anchors: list[Center]) -> DataFrame:
    """(net, centers): the same given centers for every net, as a start."""
    listed = F.array(*(F.struct(*(F.lit(float(x)).alias(c) for x, c in zip(a, "xyz"))) for a in anchors))
    return rows.select("net").distinct().withColumn("centers", listed)


def joint_sets(rows: DataFrame, k: int, site: str = "site", anchors: list[Center] | None = None, tries: int = 20, rounds: int = 12, seed: int = 0) -> DataFrame:
    """rows with set_id and similarity: one clustering of all wells of a site, so a set has one number in all of them.

    rows has the site, a well in net, id and a normal. Given anchors take the place of drawn starts.
    """
    pooled = written(rows.withColumn("__well", F.col("net")).withColumn("net", F.col(site)), "site-rows")
    centers = lloyd(pooled, anchored(pooled, anchors), rounds) if anchors else restarted(pooled, k, tries, rounds, seed)
    return labelled(pooled, centers).withColumn("net", F.col("__well")).drop("__well", "similarities")


def joint_dispersion(placed: DataFrame, site: str = "site") -> DataFrame:
    """(site, net, set_id, n, mean_angle): how far the rows of every well lie from the centers that its site shares."""
    return placed.groupBy(site, "net", "set_id").agg(F.count("*").alias("n"), F.avg(F.degrees(F.acos("similarity"))).alias("mean_angle"))


def observed_sets(rows: DataFrame, k: int, tries: int = 20, rounds: int = 12, seed: int = 0) -> DataFrame:
    """rows with set_id and similarity: sets are clustered from observed rows alone, and every row, hidden ones too, goes to the nearest.

    A net without observed rows has no sets, and its rows are left out.
    """
    return labelled(rows, restarted(rows.filter("is_obs"), k, tries, rounds, seed)).drop("similarities")


def labelled(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """rows with `similarities` to all centers, set_id of the largest (the first of equals), and that similarity."""
    n = angles.vector()
    all_of = F.transform("centers", lambda c: F.least(F.lit(1.0), F.abs(n[0] * c["x"] + n[1] * c["y"] + n[2] * c["z"])))
    return (
        rows.join(centers, "net")
        .withColumn("similarities", all_of)
        .withColumn("similarity", F.array_max("similarities"))
        .withColumn("set_id", (F.array_position("similarities", F.col("similarity")) - 1).cast("int"))
        .drop("centers")
    )


def silhouette(placed: DataFrame, by: list[str]) -> DataFrame:
    """By group: the mean of (b - a) / max(a, b), with a = 1 - |cos| to the own center and b to the nearest other one.

    Sets of one row have a = 0 and are nobody's other set; with one set of more rows, or none, b is 0. placed is
    labelled() and has each row's similarities to all centers.
    """
    sizes = placed.groupBy(*by, "set_id").agg(F.count("*").alias("m"))
    real = written(sizes.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("m") > 1, F.col("set_id")))).alias("__real")), "silhouette-sets")
    met = placed.join(real, by)
    a = F.when(F.array_contains("__real", F.col("set_id")), 1 - F.col("similarity")).otherwise(F.lit(0.0))
    other = F.array_max(F.transform(F.filter("__real", lambda k: k != F.col("set_id")), lambda k: F.get(F.col("similarities"), k)))
    b = F.when(F.size("__real") <= 1, F.lit(0.0)).otherwise(1 - other)
    one = (b - a) / F.greatest(a, b, F.lit(1e-9))
    return met.groupBy(*by).agg(F.count("*").alias("n"), F.avg(one).alias("silhouette"))


def mixture_bic(placed: DataFrame, by: list[str], k: Column) -> DataFrame:
    """By group: BIC of a mixture of one von Mises-Fisher law for each set, 3 parameters each; kappa at most 50."""
    sets = placed.groupBy(*by, "set_id").agg(F.count("*").alias("m"), F.avg("similarity").alias("r"))
    kap = F.least(F.lit(50.0), angles.kappa_from_resultant(F.col("r")))
    log_c = F.log(kap) - F.log(F.lit(4 * 3.141592653589793)) - (kap + F.log((1 - F.exp(-2 * kap)) / 2))
    total = F.sum("m").over(Window.partitionBy(*by))
    part = F.col("m") * (F.log(F.col("m") / total) + log_c + kap * F.col("r"))
    sums = sets.withColumn("__l", part).groupBy(*by).agg(F.sum("m").alias("n"), F.sum("__l").alias("log_likelihood"))
    return sums.withColumn("bic", -2 * F.col("log_likelihood") + (3 * k) * F.log("n"))


def well_tables(rows: DataFrame, k: int, rounds: int = 12, centers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Each net clustered by itself: rows with set_id, and its table (net, set_id, n, proportion, mx, my, mz, mean_angle, kappa).

    A set's direction is the mean of its rows on the side of its center; a set without rows has no line. kappa follows
    from the mean angle, and is 1 for a set of one row. Given centers (net, centers) take the place of drawn starts.
    """
    flat = written(rows, "well-rows")
    found = written(lloyd(flat, starting_centers(flat, k) if centers is None else centers, rounds), "well-centers")
    placed = written(labelled(flat, found).drop("similarities", "similarity"), "well-sets")
    turned = placed.join(found, "net").withColumn("__c", F.get("centers", F.col("set_id"))).drop("centers")
    side = angles.aligned(angles.vector(), tuple(F.col("__c")[c] for c in "xyz"))
    sums = turned.groupBy("net", "set_id").agg(F.count("*").alias("n"), *(F.sum(s).alias(c) for s, c in zip(side, ("sx", "sy", "sz"))))
    means = written(sums.select("net", "set_id", "n", *(u.alias(f"m{c}") for u, c in zip(angles.unit(angles.vector("s"), 0.0), "xyz"))), "well-means")
    spread = placed.join(means.drop("n"), ["net", "set_id"]).groupBy("net", "set_id").agg(F.avg(angles.angle(angles.vector(), angles.vector("m"))).alias("mean_angle"))
    table = means.join(spread, ["net", "set_id"]).withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy("net")))
    return placed, table.withColumn("kappa", F.when(F.col("n") < 2, 1.0).otherwise(grades.set_kappa(F.col("mean_angle")))).select("net", "set_id", "n", "proportion", "mx", "my", "mz", "mean_angle", "kappa")


def strike_sets(rows: DataFrame, k: int, rounds: int = 12, per_set: int = 10) -> DataFrame:
    """(net, set_id, n, strike, mx, my, mz, kappa) of sources that know strikes alone (net, id, strike in degrees).

    A strike is taken for a vertical plane, whose normals are clustered as undirected ones, so strikes half a turn
    apart are one. A source has a set for each per_set of its strikes, one at least and k at most. Such sets only
    confirm others: their kappa is 0.1 whatever they look like. Null strikes don't count.
    """
    known = rows.filter(F.col("strike").isNotNull()).select("net", "id", "strike")
    flat = written(known.withColumns(dict(zip(("nx", "ny", "nz"), angles.vertical_normal(F.col("strike"))))), "strikes")
    sizes = flat.groupBy("net").agg(F.least(F.lit(k), F.greatest(F.lit(1), F.floor(F.count("*") / per_set).cast("int"))).alias("__k"))
    starts = starting_centers(flat, k).join(sizes, "net").select("net", F.slice("centers", F.lit(1), F.col("__k")).alias("centers"))
    _, table = well_tables(flat, k, rounds, written(starts, "strike-starts"))
    along = F.degrees(F.atan2("my", "mx"))  # the strike lies a quarter turn from the normal
    return table.select("net", "set_id", "n", F.pmod(-along, F.lit(180.0)).alias("strike"), "mx", "my", F.lit(0.0).alias("mz"), F.lit(0.1).alias("kappa"))


def grid_scores(rows: DataFrame, found: dict[int, DataFrame], weight: str | None = None) -> DataFrame:
    """(net, k, n, silhouette, bic) of every clustering found, as silhouette() and mixture_bic(). weight names a column that says how many rows a row stands for."""
    if not found:
        return rows.select("net", F.lit(0).alias("k"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("silhouette"), F.lit(0.0).alias("bic")).limit(0)
    return by_rounds.grid_scores(rows, found, weight)


def grid_clusters(rows: DataFrame, least: int = 2, most: int = 6, rounds: int = 12) -> dict[int, DataFrame]:
    """(net, centers) for every k from least to most, all by the same rounds over the rows."""
    return lloyd_grid(rows, nested_starts(rows, range(least, most + 1)), rounds)


def nested_starts(rows: DataFrame, ks: Iterable[int]) -> dict[int, DataFrame]:
    """starting_centers() for each of ks, all from one search: the farthest first k of the most."""
    ks = list(ks)
    most = written(starting_centers(rows, max(ks)), "starts")
    return {k: most.select("net", F.slice("centers", 1, k).alias("centers")) for k in ks}


def choose_k(rows: DataFrame, least: int = 2, most: int = 6, rounds: int = 12) -> DataFrame:
    """(net, k, n, silhouette, bic, chosen): scores for each k, the best silhouette chosen, the smaller k of equals.

    Rows of one normal are one row that stands for as many. All k are clustered by the same scans and scored by the
    same ones. Only k below a net's rows count.
    """
    starts = nested_starts(rows, range(least, most + 1))
    apart = written(rows.groupBy("net", "nx", "ny", "nz").agg(F.count("*").alias("n")), "normals")
    scores = grid_scores(apart, lloyd_grid(apart, starts, rounds, "n"), "n").filter(F.col("k") < F.col("n"))
    w = Window.partitionBy("net").orderBy(F.desc("silhouette"), "k")
    return scores.withColumn("chosen", F.row_number().over(w) == 1)


def joint_choose_k(rows: DataFrame, site: str = "site", least: int = 2, most: int = 12, rounds: int = 12) -> DataFrame:
    """choose_k() of all wells of a site together: (site, k, n, silhouette, bic, chosen)."""
    pooled = rows.select(F.col(site).alias("net"), F.struct("net", "id").alias("id"), "nx", "ny", "nz")
    return choose_k(pooled, least, most, rounds).withColumnRenamed("net", site)


def fused_k(scores: DataFrame, rows: DataFrame, kind: str | None = None, kind_most: dict[str, int] | None = None) -> DataFrame:
    """(net, k_silhouette, k_data, k, per_kind): the best silhouette's k of choose_k(), held below what the rows can carry.

    k_data is grades.recommended_k() of the number of rows. kind names a column of the rows: per_kind then maps each of
    its values to what its own rows can carry, at most what kind_most says; a null value has none.
    """
    best = scores.filter("chosen").select("net", F.col("k").alias("k_silhouette"))
    sizes = rows.groupBy("net").agg(F.count("*").alias("n"))
    out = best.join(sizes, "net").withColumn("k_data", grades.recommended_k(F.col("n"))).select("net", "k_silhouette", "k_data", F.greatest(F.lit(2), F.least("k_silhouette", "k_data")).alias("k"))
    if kind is None:
        return out.withColumn("per_kind", F.expr("cast(map() as map<string,int>)"))
    carried = grades.recommended_k(F.col("n"))
    for name, top in (kind_most or {}).items():
        carried = F.when(F.col(kind) == name, F.least(carried, F.lit(top))).otherwise(carried)
    kinds = rows.filter(F.col(kind).isNotNull()).groupBy("net", kind).agg(F.count("*").alias("n")).groupBy("net").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(kind).cast("string"), carried)))).alias("per_kind"))
    return out.join(kinds, "net", "left")


#: Gauss-Legendre places and weights on 0 to 1, for the mean of t * t under exp(kappa * (t * t - 1)).
_T, _W = (lambda x, w: ((x + 1) / 2, w / 2))(*np.polynomial.legendre.leggauss(64))
KAPPA_LO, KAPPA_HI = 0.5, 400.0


def axial_moment(kappa: np.ndarray) -> np.ndarray:
    """The mean of (n . c) ** 2 under a density that goes as exp(kappa * (n . c) ** 2) around the axis c."""
    p = np.exp(np.asarray(kappa)[:, None] * (_T * _T - 1)) * _W
    return (p * _T * _T).sum(axis=1) / p.sum(axis=1)


def solve_kappa(moment: np.ndarray) -> np.ndarray:
    """The concentration with this axial_moment, which grows with it; held between KAPPA_LO and KAPPA_HI."""
    lo, hi = np.full(len(moment), KAPPA_LO), np.full(len(moment), KAPPA_HI)
    for _ in range(60):
        middle = (lo + hi) / 2
        above = axial_moment(middle) < moment
        lo, hi = np.where(above, middle, lo), np.where(above, hi, middle)
    return (lo + hi) / 2


def em_mixture(rows: DataFrame, centers: DataFrame, rounds: int = 20, weight: str | None = None) -> DataFrame:
    """(net, k, cx, cy, cz, kappa, share, ess): a mixture of axial laws fitted to each net's normals by EM.

    centers is (net, centers) as starting_centers() or lloyd() give. A round gives each row its part in every set
    and sums, for each set, the parts, their squares and the weighted products of normals; from these few sums
    follow the set's axis (first eigenvector), concentration (the moment along it) and share. Rows are read once
    a round whatever a net's size. weight names a column of row weights, as terzaghi() gives; ess is the
    effective number of rows behind a set. A set whose parts add up to nothing keeps what it had.
    """
    from .aggregates import eigen

    w = F.col(weight) if weight else F.lit(1.0)
    points = written(rows.select("net", "nx", "ny", "nz", w.cast("double").alias("w")), "em-rows")
    model = centers.select("net", F.posexplode("centers").alias("k", "c"), F.size("centers").alias("m")).select("net", "k", *(F.col(f"c.{c}").alias(f"c{c}") for c in "xyz"), F.lit(10.0).alias("kappa"), (1 / F.col("m")).alias("share"), F.lit(0.0).alias("ess"))
    model = written(model, "em-model")
    sets = range((model.agg(F.max("k")).first()[0] + 1) if not model.isEmpty() else 0)
    n = angles.vector()
    v, products = dict(zip("xyz", n)), ("xx", "xy", "xz", "yy", "yz", "zz")
    # a set that a net has not is null, and has no part in its rows
    logs = {f"l{i}": F.col(f"base{i}") + F.col(f"kappa{i}") * (F.pow(n[0] * F.col(f"cx{i}") + n[1] * F.col(f"cy{i}") + n[2] * F.col(f"cz{i}"), F.lit(2.0)) - 1) for i in sets}
    most = {"top": F.greatest(*(F.col(f"l{i}") for i in sets)) if len(sets) > 1 else F.col("l0")}
    apart = {f"p{i}": F.coalesce(F.exp(F.col(f"l{i}") - F.col("top")), F.lit(0.0)) for i in sets}
    held = {"unit": F.try_divide("w", sum((F.col(f"p{i}") for i in sets), F.lit(0.0)))}
    shares = {f"r{i}": F.col(f"p{i}") * F.col("unit") for i in sets}
    steps = [logs, most, apart, held, shares]
    added = [x for i in sets for x in (F.sum(f"r{i}").alias(f"r{i}"), F.sum(F.col(f"r{i}") * F.col(f"r{i}")).alias(f"q{i}"), *(F.sum(F.col(f"r{i}") * v[a] * v[b]).alias(f"s{a}{b}{i}") for a, b in products))]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col(f"r{i}").alias("r"), F.col(f"q{i}").alias("q"), *(F.col(f"s{p}{i}").alias(f"s{p}") for p in products)) for i in sets))).alias("e")

    def normed(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            yield pdf.assign(log_z=np.log((np.exp(pdf["kappa"].to_numpy()[:, None] * (_T * _T - 1)) * _W).sum(axis=1)))

    def concentrated(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            yield pdf.assign(new_kappa=solve_kappa(pdf["l1"].to_numpy()))

    net = rows.schema["net"].dataType.simpleString()
    for _ in range(rounds if sets else 0):
        told = model.mapInPandas(normed, f"net {net}, k int, cx double, cy double, cz double, kappa double, share double, ess double, log_z double")
        law = {"cx": F.col("cx"), "cy": F.col("cy"), "cz": F.col("cz"), "kappa": F.col("kappa"), "base": F.log("share") - F.col("log_z")}
        flat = told.groupBy("net").agg(*(F.max(F.when(F.col("k") == i, x)).alias(f"{c}{i}") for i in sets for c, x in law.items()))
        flat = written(flat, "em-laws")  # so that Spark knows how small it is, and rows meet it without a shuffle
        # flat columns and one sum for each: generated code, and no row for a row and a set
        sums = _placed(points.join(flat, "net"), steps).groupBy("net").agg(*added).select("net", each).filter("e.r > 1e-9")
        sums = sums.select("net", "e.k", "e.r", (F.col("e.r") * F.col("e.r") / F.col("e.q")).alias("ess"), *((F.col(f"e.s{p}") / F.col("e.r")).alias(f"s{p}") for p in products))
        sums = written(sums, "em-sums")
        axes = eigen(sums, ["net", "k"])
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in axes.schema)
        axes = axes.mapInPandas(concentrated, kinds + ", new_kappa double").select("net", "k", *(F.col(f"e1{c}") for c in "xyz"), "new_kappa")
        total = sums.groupBy("net").agg(F.sum("r").alias("total"))
        new = axes.join(sums.select("net", "k", "r", F.col("ess").alias("new_ess")), ["net", "k"]).join(total, "net").withColumn("new_share", F.col("r") / F.col("total"))
        model = written(
            model.join(new, ["net", "k"], "left").select("net", "k", *(F.coalesce(f"e1{c}", f"c{c}").alias(f"c{c}") for c in "xyz"), F.coalesce("new_kappa", "kappa").alias("kappa"), F.coalesce("new_share", F.lit(1e-9)).alias("share"), F.coalesce("new_ess", F.lit(0.0)).alias("ess")),
            "em-model",
        )
    return model


def decoded(model: DataFrame, least_ess: float = 5.0) -> DataFrame:
    """The mixture as a set table: (net, set_id, share, ess, kappa, dip, dip_dir, enough), sets by falling share; enough says whether ess passes the gate."""
    c = angles.vector("c")
    place = F.row_number().over(Window.partitionBy("net").orderBy(F.desc("share"), "k")) - 1
    return model.select("net", place.alias("set_id"), "share", "ess", "kappa", angles.dip(c).alias("dip"), angles.dip_direction(c).alias("dip_dir"), (F.col("ess") >= least_ess).alias("enough"))
