"""Sets estimated from what a survey saw, their scores against the truth, and whole surveys: cluster, predict, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles
from . import aggregates, clusters, fusion, predict, quality
from .tables import written

Centers = list[tuple[float, float, float]] | DataFrame


def required(rows: DataFrame, columns: list[str], who: str) -> DataFrame:
    """rows, unchanged; where columns are missing, an error that names them and those that are there."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{who}: columns {missing} are missing; there are {rows.columns}")
    return rows


def net_checks(rows: DataFrame) -> DataFrame:
    """(net, n, n_missing, n_infinite, n_zero, first_bad, usable): what is wrong with each net's normals.

    A row counts once: as missing if a part is null, else as infinite if one is not a finite number, else as zero if
    its length is below 1e-9. first_bad is the smallest id of such a row, null without one. Rows without a net form
    a net of their own, null.
    """
    n = angles.vector()
    missing, infinite = F.lit(False), F.lit(False)
    for x in n:
        missing |= x.isNull()
        infinite |= F.isnan(x) | (F.abs(x) == float("inf"))
    kind = F.when(missing, "missing").when(infinite, "infinite").when(angles.length(n) < 1e-9, "zero")
    told = required(rows, ["net", "id", "nx", "ny", "nz"], "net_checks").select("net", "id", kind.alias("kind"))
    bad = {k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("missing", "infinite", "zero")}
    out = told.groupBy("net").agg(F.count("*").alias("n"), *bad.values(), F.min(F.when(F.col("kind").isNotNull(), F.col("id"))).alias("first_bad"))
    return out.withColumn("usable", F.col("n_missing") + F.col("n_infinite") + F.col("n_zero") == 0)


def set_directions(rows: DataFrame, most: int = 8) -> DataFrame:
    """(net, set_id, n_obs, mx, my, mz, borrowed): each set's mean observed normal, on the side of its first by id.

    Only observed rows are read, also for a set that has none: it borrows the mean of all the net's observed normals,
    or (0, 0, 1) where there is none either. Normals shorter than 1e-6 don't count. Rows with a null or negative
    set_id are in no set; a set_id of `most` or more fails when it is read, so that nothing is cut off.
    """
    sets = F.when(F.col("set_id") >= most, F.raise_error(F.format_string(f"set_directions: set_id %s of net %s is not below {most}", F.col("set_id").cast("string"), F.col("net").cast("string")))).otherwise(F.col("set_id"))
    rows = rows.filter("set_id >= 0").withColumn("set_id", sets)
    seen = rows.filter(F.col("is_obs") & (angles.length(angles.vector()) > 1e-6)).withColumns(dict(zip(("nx", "ny", "nz"), angles.unit(angles.vector(), 0.0))))

    def means(by: list[str], to: str) -> DataFrame:
        first = seen.groupBy(*by).agg(F.min_by(F.struct("nx", "ny", "nz"), "id").alias("r"))
        side = angles.aligned(angles.vector(), tuple(F.col("r")[f"n{c}"] for c in "xyz"))
        sums = seen.join(first, by).groupBy(*by).agg(F.count("*").alias(f"{to}n"), *(F.avg(s).alias(k) for s, k in zip(side, ("sx", "sy", "sz"))))
        told = sums.filter(angles.length(angles.vector("s")) > 1e-6)
        return told.select(*by, f"{to}n", *(u.alias(f"{to}{c}") for u, c in zip(angles.unit(angles.vector("s"), 0.0), "xyz")))

    every = rows.select("net", "set_id").distinct()
    met = every.join(means(["net", "set_id"], "o"), ["net", "set_id"], "left").join(means(["net"], "g"), "net", "left")
    parts = (F.coalesce(f"o{c}", f"g{c}", F.lit(1.0 if c == "z" else 0.0)).alias(f"m{c}") for c in "xyz")
    return met.select("net", "set_id", F.coalesce("on", F.lit(0)).alias("n_obs"), *parts, F.col("on").isNull().alias("borrowed"))


def estimated_sets(rows: DataFrame, centers: Centers, observed_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(net, set_id, n_points, mx, my, mz) of the sets estimated, and rows (net, id, set_id, angle) that go to each.

    Rows are grouped around centers (given ones, or (net, centers) as k-means gives them); a set's direction is the
    mean of its rows on its center's side, and then every row, hidden ones too, goes to the nearest direction, the
    smaller number of equals. observed_only leaves hidden rows out of the means; without it they leak into them. A
    set of no rows is left out. A net of one row to learn from has that row as its one set 0, which its observed
    rows go to; a net without any has no sets. Rows without a set have -1 and no angle.
    """
    rows = rows.select("net", "id", "nx", "ny", "nz", "is_obs")
    used = rows.filter("is_obs") if observed_only else rows
    sizes = written(used.groupBy("net").agg(F.count("*").alias("n"), F.min_by(F.struct(*(F.col(f"n{c}").alias(c) for c in "xyz")), "id").alias("only")), "survey-sizes")
    many = used.join(sizes.filter("n >= 2").select("net"), "net", "left_semi")
    own = clusters.anchored(many, centers) if isinstance(centers, list) else centers
    told = clusters.labelled(many, own).drop("similarities", "similarity").join(own, "net").withColumn("__c", F.get("centers", F.col("set_id")))
    side = angles.aligned(angles.vector(), tuple(F.col("__c")[c] for c in "xyz"))
    sums = told.groupBy("net", "set_id").agg(*(F.sum(s).alias(k) for s, k in zip(side, ("sx", "sy", "sz"))))
    modes = sums.select("net", "set_id", *(u.alias(f"m{c}") for u, c in zip(angles.unit(angles.vector("s"), 1e-12), "xyz")))
    alone = sizes.filter("n = 1").select("net", F.lit(0).alias("set_id"), *(F.col(f"only.{c}").alias(f"m{c}") for c in "xyz"))
    modes = written(modes.unionByName(alone), "survey-modes")
    listed = F.array_sort(F.collect_list(F.struct("set_id", *(F.col(f"m{c}").alias(c) for c in "xyz"))))
    by_net = modes.groupBy("net").agg(listed.alias("modes")).join(sizes.select("net", "n"), "net")
    n = angles.vector()
    cos = F.transform("modes", lambda m: F.least(F.lit(1.0), F.abs(n[0] * m["x"] + n[1] * m["y"] + n[2] * m["z"])))
    met = rows.join(by_net, "net", "left").withColumn("__s", F.when((F.col("n") >= 2) | F.col("is_obs"), cos)).withColumn("__b", F.array_max("__s"))
    at = F.get("modes", (F.array_position("__s", F.col("__b")) - 1).cast("int"))["set_id"]
    placed = written(met.select("net", "id", F.coalesce(at, F.lit(-1)).alias("set_id"), F.degrees(F.acos("__b")).alias("angle")), "survey-rows")
    counts = placed.groupBy("net", "set_id").agg(F.count("*").alias("n_points"))
    table = modes.join(counts, ["net", "set_id"], "left")
    return table.select("net", "set_id", F.coalesce("n_points", F.lit(0)).alias("n_points"), "mx", "my", "mz"), placed


def set_spread(placed: DataFrame) -> DataFrame:
    """(net, set_id, n, dispersion, max_deviation, statistical) of rows with set_id and angle: the angle of their mean cosine, and the largest; 3 rows make statistics."""
    told = placed.filter("set_id >= 0").groupBy("net", "set_id").agg(F.count("*").alias("n"), F.avg(F.cos(F.radians("angle"))).alias("__c"), F.max("angle").alias("max_deviation"))
    return told.select("net", "set_id", "n", F.degrees(F.acos(F.least(F.lit(1.0), F.col("__c")))).alias("dispersion"), "max_deviation", (F.col("n") >= 3).alias("statistical"))


def table_scores(predicted: DataFrame, truth: DataFrame, labels: DataFrame | None = None, success: float = 30.0) -> DataFrame:
    """(net, k_pred, k_true, k_diff, modal_error, coverage, n_matched, n_success, ari) of two set tables of each net.

    Sets are matched one to one at the least sum of angles. A net that only one table has, or with nothing matched,
    has a modal error of 90 and no coverage. labels (net, id, predicted, true) give the adjusted Rand index, else null.
    """
    p = predicted.select("net", F.col("set_id").alias("set_a"), *(F.col(f"m{c}").alias(f"a{c}") for c in "xyz"))
    t = truth.select("net", F.col("set_id").alias("set_b"), *(F.col(f"m{c}").alias(f"b{c}") for c in "xyz"))
    pairs = p.join(t, "net").select(F.col("net").alias("a"), F.col("net").alias("b"), "set_a", "set_b", angles.angle(angles.vector("a"), angles.vector("b")).alias("angle"))
    got = fusion.matches(pairs).groupBy(F.col("a").alias("net")).agg(F.count("*").alias("n_matched"), F.avg("angle").alias("modal_error"), F.count(F.when(F.col("angle") < success, 1)).alias("n_success"))
    sizes = p.groupBy("net").agg(F.count("*").alias("k_pred")).join(t.groupBy("net").agg(F.count("*").alias("k_true")), "net", "full").fillna(0, ["k_pred", "k_true"])
    out = sizes.join(got, "net", "left").fillna(0, ["n_matched", "n_success"]).fillna(90.0, ["modal_error"])
    out = out.withColumn("k_diff", F.abs(F.col("k_pred") - F.col("k_true"))).withColumn("coverage", F.col("n_success") / F.greatest("k_true", F.lit(1)))
    ari = aggregates.rand_index(labels, ["net"], "predicted", "true").select("net", "ari") if labels is not None else None
    out = out.join(ari, "net", "left") if ari is not None else out.withColumn("ari", F.lit(None).cast("double"))
    return out.select("net", "k_pred", "k_true", "k_diff", "modal_error", "coverage", "n_matched", "n_success", "ari")


def chosen_centers(rows: DataFrame, least: int = 2, most: int = 7, rounds: int = 12) -> DataFrame:
    """(net, k, centers) of the number of sets with the best silhouette, the smaller of equals.

    All numbers are clustered by the same scans. A net with no more rows than `least` is one set, around its first row.
    """
    rows = written(rows.select("net", "id", "nx", "ny", "nz"), "survey-rows")
    grid = {k: written(c, "survey-centers") for k, c in clusters.grid_clusters(rows, least, most, rounds).items()}
    scores = clusters.grid_scores(rows, grid).filter(F.col("k") < F.col("n"))
    w = Window.partitionBy("net").orderBy(F.desc("silhouette"), "k")
    best = scores.withColumn("__o", F.row_number().over(w)).filter("__o = 1").select("net", "k")
    every = None
    for k, c in grid.items():
        one = c.select("net", "centers", F.lit(k).alias("k"))
        every = one if every is None else every.unionByName(one)
    chosen = written(best.join(every, ["net", "k"]).select("net", "k", "centers"), "survey-chosen")
    small = rows.join(chosen, "net", "left_anti").groupBy("net").agg(F.min_by(F.struct(*(F.col(f"n{c}").alias(c) for c in "xyz")), "id").alias("c"))
    return chosen.unionByName(small.select("net", F.lit(1).alias("k"), F.array("c").alias("centers")))


def _measured(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """(net, k, n, mae, p50, p90) of predict.set_aware() with the sets around centers; every row knows its set."""
    placed = clusters.labelled(rows, centers.select("net", "centers")).drop("similarities", "similarity")
    stats = aggregates.error_stats(predict.errors(predict.set_aware(predict.blind(placed)), placed), ["net"])
    return stats.join(centers.select("net", F.size("centers").alias("k")), "net").select("net", "k", "n", "mae", "p50", "p90")


def full_survey(rows: DataFrame, centers: Centers | None = None, least: int = 2, most: int = 7, rounds: int = 12) -> DataFrame:
    """(net, k, n, mae, p50, p90) where all normals were surveyed: sets come from every row, then hidden rows are predicted from observed ones.

    rows has net, id, px, py, pz, nx, ny, nz, is_obs. Without given centers, their number is chosen_centers()'. Nets
    without hidden or without observed rows are left out.
    """
    rows = rows.drop("set_id")
    return _measured(rows, _centers(rows, centers, least, most, rounds))


def block_survey(rows: DataFrame, share: float = 0.4, centers: Centers | None = None, least: int = 2, most: int = 7, rounds: int = 12) -> DataFrame:
    """full_survey() where only a block was surveyed: the share of each net that quality.spatial_block() observes, whose rows alone make the sets."""
    rows = written(quality.spatial_block(rows.drop("set_id", "is_obs"), share), "survey-block")
    return _measured(rows, _centers(rows.filter("is_obs"), centers, least, most, rounds))


def _centers(rows: DataFrame, centers: Centers | None, least: int, most: int, rounds: int) -> DataFrame:
    if centers is None:
        return written(chosen_centers(rows, least, most, rounds), "survey-centers")
    return clusters.anchored(rows, centers) if isinstance(centers, list) else centers
