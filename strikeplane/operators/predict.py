"""Directions of hidden rows from observed ones, and blind evaluation.

A predictor takes rows (net, id, px, py, pz, nx, ny, nz, is_obs) whose hidden normals are null (quality.hide) and
gives (net, id, qx, qy, qz), the predicted normals of the hidden rows. The truth is joined only afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles
from . import neighbours
from .tables import written

Predictor = Callable[[DataFrame], DataFrame]


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter("is_obs"), rows.filter(~F.col("is_obs")).select("net", "id", "px", "py", "pz")


def looked_up(rows: DataFrame, k: int) -> DataFrame:
    """neighbours.nearest() of the hidden rows among the observed ones, written: for predictors that take it as `found`, so that one search serves them all."""
    seen, hidden = _split(rows)
    return written(neighbours.nearest(hidden, seen, k), "nearest")


def _near(hidden: DataFrame, seen: DataFrame, k: int, found: DataFrame | None) -> DataFrame:
    """The k nearest observed rows, out of found where it is given: looked_up() for k or more."""
    return neighbours.nearest(hidden, seen, k) if found is None else found.filter(F.col("rank") <= k)


def nearest_direction(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The normal of the nearest observed row of the net."""
    seen, hidden = _split(rows)
    near = _near(hidden, seen, 1, found)
    return near.join(seen.select("net", F.col("id").alias("other"), *(F.col(f"n{c}").alias(f"q{c}") for c in "xyz")), ["net", "other"]).select("net", "id", "qx", "qy", "qz", "d2")


def global_direction(rows: DataFrame) -> DataFrame:
    """The principal axis of the net's observed normals, for every hidden row."""
    from .aggregates import eigen, scatter

    seen, hidden = _split(rows)
    axis = eigen(scatter(seen, ["net"]), ["net"]).select("net", *(F.col(f"e1{c}").alias(f"q{c}") for c in "xyz"))
    return hidden.join(axis, "net").select("net", "id", "qx", "qy", "qz")


def majority(rows: DataFrame, centers: list[tuple[float, float, float]], k: int = 16, least_share: float = 0.6, found: DataFrame | None = None) -> DataFrame:
    """The center that most of the k nearest observed rows belong to, if least_share of them do; else the nearest row's normal.

    Of sets with equal votes the smaller number wins.
    """
    from .aggregates import assign

    seen, hidden = _split(rows)
    sets = assign(seen, centers).select("net", F.col("id").alias("other"), "set_id", *(F.col(f"n{c}").alias(f"m{c}") for c in "xyz"))
    near = _near(hidden, seen, k, found).join(sets, ["net", "other"])
    first = near.filter("rank = 1").select("net", "id", "mx", "my", "mz")
    votes = near.groupBy("net", "id", "set_id").agg(F.count("*").alias("votes"))
    best = votes.groupBy("net", "id").agg(F.sum("votes").alias("all"), F.max(F.struct("votes", (-F.col("set_id")).alias("k"))).alias("b"))
    table = F.array(*(F.struct(*(F.lit(float(x)).alias(c) for x, c in zip(v, "xyz"))) for v in centers))
    won = F.get(table, -F.col("b.k"))
    enough = F.col("b.votes") >= least_share * F.col("all")
    return best.join(first, ["net", "id"]).select("net", "id", *(F.when(enough, won[c]).otherwise(F.col(f"m{c}")).alias(f"q{c}") for c in "xyz"))


def set_aware(rows: DataFrame, by: str = "set_id") -> DataFrame:
    """The mean of the observed normals of a hidden row's own set, or of all sets where it has none."""
    seen = rows.filter("is_obs")
    first = seen.groupBy("net", by).agg(F.min_by(F.struct("nx", "ny", "nz"), "id").alias("r"))
    turned = seen.join(first, ["net", by]).withColumns({f"r{c}": F.col("r")[f"n{c}"] for c in "xyz"})
    side = angles.aligned(angles.vector(), angles.vector("r"))
    own = turned.groupBy("net", by).agg(*(F.avg(s).alias(c) for s, c in zip(side, ("sx", "sy", "sz"))))
    own = own.select("net", by, *(u.alias(c) for u, c in zip(angles.unit(angles.vector("s"), 1e-12), ("ox", "oy", "oz"))))
    lead = seen.groupBy("net").agg(F.min_by(F.struct("nx", "ny", "nz"), "id").alias("r"))
    all_turned = seen.join(lead, "net").withColumns({f"r{c}": F.col("r")[f"n{c}"] for c in "xyz"})
    total = all_turned.groupBy("net").agg(*(F.avg(s).alias(c) for s, c in zip(side, ("sx", "sy", "sz"))))
    total = total.select("net", *(u.alias(c) for u, c in zip(angles.unit(angles.vector("s"), 1e-12), ("gx", "gy", "gz"))))
    hidden = rows.filter(~F.col("is_obs")).select("net", "id", by)
    return hidden.join(own, ["net", by], "left").join(total, "net").select("net", "id", *(F.coalesce(f"o{c}", f"g{c}").alias(f"q{c}") for c in "xyz"))


def fracture_aware(rows: DataFrame, least_points: int = 3) -> DataFrame:
    """The plane through the observed points of a hidden row's own fracture; of fewer points, its mean normal.

    A fracture without observed points takes what set_aware gives. Moments are summed by Spark; the smallest
    eigenvector of each fracture's 3 x 3 matrix is the plane's normal.
    """
    from .aggregates import eigen

    seen = rows.filter(F.col("is_obs") & (F.col("fracture_id") >= 0))
    p = dict(zip("xyz", angles.vector("p")))
    center = seen.groupBy("net", "fracture_id").agg(F.count("*").alias("n"), *(F.avg(p[c]).alias(f"c{c}") for c in "xyz"))
    d = {c: p[c] - F.col(f"c{c}") for c in "xyz"}
    moments = seen.join(center, ["net", "fracture_id"]).groupBy("net", "fracture_id").agg(
        F.first("n").alias("n"), *(F.avg(d[a] * d[b]).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    )
    plane = eigen(moments.filter(F.col("n") >= least_points), ["net", "fracture_id"]).filter("l2 > 1e-12").select("net", "fracture_id", *(F.col(f"e3{c}").alias(f"f{c}") for c in "xyz"))
    fallback = set_aware(rows).withColumnsRenamed({f"q{c}": f"b{c}" for c in "xyz"})
    hidden = rows.filter(~F.col("is_obs")).select("net", "id", "fracture_id")
    return hidden.join(plane, ["net", "fracture_id"], "left").join(fallback, ["net", "id"]).select("net", "id", *(F.coalesce(f"f{c}", f"b{c}").alias(f"q{c}") for c in "xyz"))


def projective_median(normals: np.ndarray, weights: np.ndarray, start: np.ndarray, rounds: int = 40, eps: float = 1e-3) -> np.ndarray:
    """For each row of weights, the undirected direction of least weighted sum of angles to the normals, from start on.

    The angle's slope is one over its sine, so each round is a mean weighted by that. A direction that no longer
    moves is done. Weights are not negative.
    """
    v = np.broadcast_to(start, (len(weights), 3)).copy()
    going, turned = np.arange(len(weights)), np.ascontiguousarray(normals.T)
    for _ in range(rounds):
        c = v[going] @ turned + 0.0
        w = c * c
        np.subtract(1.0, w, out=w)
        np.maximum(w, eps * eps, out=w)
        np.sqrt(w, out=w)
        np.divide(weights, w, out=w)
        np.copysign(w, c, out=w)
        new = w @ normals
        size = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(size > 1e-12, new / np.maximum(size, 1e-12), v[going])
        moves = np.abs(new - v[going]).max(axis=1) > 1e-13
        v[going] = new
        if not moves.any():
            break
        if not moves.all():
            going, weights = going[moves], weights[moves]
    return v


def global_median(normals: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The direction of least sum of angles to all normals, from their principal axis on."""
    return projective_median(normals, np.ones((1, len(normals))), np.linalg.eigh(normals.T @ normals)[1][:, -1], rounds)[0]


def local_median(rows: DataFrame, h: float = 0.5, c: float = 0.1, rounds: int = 40, chunk: int = 4096) -> DataFrame:
    """The direction of least angle to all observed normals of the net, weighted by exp(-d / (h * spread)) + c.

    spread is the mean of the standard deviations of all the net's places along the axes; the search starts at
    the net's global_median(). Hidden rows are dealt to chunks by a hash, and a net's observed rows go to each of
    its chunks, so they must fit into a task; a chunk's weights are made in slices. Nets without observed rows
    give nothing; under three observed, their mean.
    """
    seen, hidden = _split(rows)
    spread = rows.groupBy("net").agg((sum((F.stddev_pop(p) for p in ("px", "py", "pz")), F.lit(0.0)) / 3).alias("spread"))
    sizes = hidden.groupBy("net").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")).join(spread, "net")
    named = lambda names: [F.col(c).alias(c) for c in names]  # noqa: E731  columns of their own on either side
    left = hidden.join(sizes, "net").select(*named(("net", "id", "px", "py", "pz", "spread")), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    right = seen.join(sizes, "net").select(*named(("net", "id", "px", "py", "pz", "nx", "ny", "nz")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = a[["net", "id"]].copy()
        if not len(a) or not len(b):
            return out.iloc[:0].assign(qx=0.0, qy=0.0, qz=0.0)
        b = b.sort_values("id")
        p, n, q = b[["px", "py", "pz"]].to_numpy(), b[["nx", "ny", "nz"]].to_numpy(), a[["px", "py", "pz"]].to_numpy()
        whole = max(float(a["spread"].iloc[0]), 1e-9)
        if len(b) < 3:
            mean = (n * np.where(n @ n[0] < 0, -1.0, 1.0)[:, None]).mean(axis=0)
            got = np.tile(mean / max(np.linalg.norm(mean), 1e-12), (len(a), 1))
        else:
            start = global_median(n, rounds)
            got = np.concatenate([
                projective_median(n, np.exp(-np.linalg.norm(part[:, None] - p[None], axis=2) / (h * whole)) + c, start, rounds)
                for part in np.array_split(q, max(1, len(q) * len(p) // 65_536))
            ])
        return out.assign(qx=got[:, 0], qy=got[:, 1], qz=got[:, 2])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    # told how many tasks: by their bytes alone the chunks would be put together into few
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (x.repartition(tasks, "net", "part") for x in (left, right))
    return left.groupBy("net", "part").cogroup(right.groupBy("net", "part")).applyInPandas(solve, f"net {kinds['net']}, id {kinds['id']}, qx double, qy double, qz double")


#: Centers that all nets share, or each net's own as (net, centers).
Centers = list[tuple[float, float, float]] | DataFrame


def _set_axes(seen: DataFrame, centers: Centers) -> tuple[DataFrame, DataFrame]:
    """Observed rows (net, other, set_id, mx, my, mz) by their nearest center, and each net's `axes`: map of set_id to the set's mean."""
    from .clusters import anchored, labelled

    own = anchored(seen, centers) if isinstance(centers, list) else centers
    sets = labelled(seen, own).drop("similarities", "similarity")
    told = sets.join(own, "net").withColumn("__c", F.get("centers", F.col("set_id"))).drop("centers")
    side = angles.aligned(angles.vector(), tuple(F.col("__c")[c] for c in "xyz"))
    sums = told.groupBy("net", "set_id").agg(*(F.sum(s).alias(k) for s, k in zip(side, ("sx", "sy", "sz"))))
    means = sums.select("net", "set_id", F.struct(*(u.alias(k) for u, k in zip(angles.unit(angles.vector("s"), 1e-12), "xyz"))).alias("m"))
    axes = means.groupBy("net").agg(F.map_from_entries(F.collect_list(F.struct("set_id", "m"))).alias("axes"))
    return sets.select("net", F.col("id").alias("other"), "set_id", *(F.col(f"n{x}").alias(f"m{x}") for x in "xyz")), axes


def observed_centers(rows: DataFrame, ks: tuple[int, ...], rounds: int = 12) -> dict[int, DataFrame]:
    """(net, centers) of each k from the observed rows alone, all k by the same rounds over them."""
    from .clusters import lloyd_grid, nested_starts

    seen = written(rows.filter("is_obs").select("net", "id", "nx", "ny", "nz"), "observed")
    return {k: written(c, "observed-centers") for k, c in lloyd_grid(seen, nested_starts(seen, ks), rounds).items()}


def set_aware_clustered(rows: DataFrame, k: int, rounds: int = 12) -> DataFrame:
    """set_aware_observed() with the sets that the observed rows themselves form."""
    return set_aware_observed(rows, observed_centers(rows, (k,), rounds)[k])


def top_two_ensemble(rows: DataFrame, ks: tuple[int, ...] = (4, 3, 5, 6), near: int = 24, rounds: int = 12, found: DataFrame | None = None, centers: dict[int, DataFrame] | None = None) -> DataFrame:
    """top_two() with the sets that the observed rows form, for each of ks; their mean, each on the side of the first.

    All clusterings come from the same rounds, and the nearest rows are looked up once, unless they are given as
    looked_up() and observed_centers() of the same rows. A net with fewer than 4
    observed rows takes the mean of their normals, on the side of the first by id.
    """
    seen, hidden = _split(rows)
    sizes = written(seen.groupBy("net").agg(F.count("*").alias("n"), F.min_by(F.struct("nx", "ny", "nz"), "id").alias("r")), "observed-sizes")
    enough = rows.join(sizes.filter("n >= 4").select("net"), "net", "left_semi")
    some, rest = _split(enough)
    found = looked_up(enough, near) if found is None else _near(rest, some, near, found)
    centers = centers or observed_centers(enough, ks, rounds)
    mixed = fused([_two_mixed(found, some, centers[k], 0.8, 0.6) for k in ks])
    return mixed.unionByName(_plain_means(seen.join(sizes.filter("n < 4"), "net"), hidden))


def _plain_means(few: DataFrame, hidden: DataFrame) -> DataFrame:
    """For hidden rows the mean of their net's observed normals, each on the side of the net's first, r."""
    side = angles.aligned(angles.vector(), tuple(F.col("r")[f"n{c}"] for c in "xyz"))
    means = few.groupBy("net").agg(*(F.sum(s).alias(c) for s, c in zip(side, ("sx", "sy", "sz"))))
    axes = means.select("net", *(u.alias(f"q{c}") for u, c in zip(angles.unit(angles.vector("s"), 1e-12), "xyz")))
    return hidden.select("net", "id").join(axes, "net").select("net", "id", "qx", "qy", "qz")


def semantic(rows: DataFrame, centers: Centers, k: int = 6, blend: float = 0.5) -> DataFrame:
    """The nearest observed row's normal, drawn to the mean of its set by `blend` (0: the normal alone).

    Sets are those of observed rows around centers, of k sets. Means are turned to the side of that normal. A net of
    fewer than 4 observed rows (or than k, if that is less) takes the mean of their normals; without any it has none.
    """
    seen, hidden = _split(rows)
    sizes = written(seen.groupBy("net").agg(F.count("*").alias("n"), F.min_by(F.struct("nx", "ny", "nz"), "id").alias("r")), "observed-sizes")
    few = F.col("n") < min(4, k)
    some, rest = _split(rows.join(sizes.filter(~few).select("net"), "net", "left_semi"))
    sets, axes = _set_axes(some, centers)
    near = neighbours.nearest(rest, some, 1).join(sets, ["net", "other"]).join(axes, "net")
    mean = _turned(F.element_at("axes", F.col("set_id")))
    mixed = angles.unit(tuple(blend * a + b for a, b in zip(mean, angles.vector("m"))), 1e-12)
    drawn = near.select("net", "id", *(x.alias(f"q{c}") for x, c in zip(mixed, "xyz")))
    return drawn.unionByName(_plain_means(seen.join(sizes.filter(few), "net"), hidden))


def global_median_direction(rows: DataFrame, rounds: int = 40) -> DataFrame:
    """The direction of least sum of angles to all the net's observed normals, for every hidden row."""
    from .means import median_directions

    seen, hidden = _split(rows)
    found = median_directions(seen, ["net"], rounds=rounds)
    return hidden.select("net", "id").join(found, "net").select("net", "id", *(F.col(f"m{c}").alias(f"q{c}") for c in "xyz"))


def _turned(axis: Column) -> angles.Vector:
    return angles.aligned((axis["x"], axis["y"], axis["z"]), angles.vector("m"))


def set_aware_observed(rows: DataFrame, centers: Centers, found: DataFrame | None = None) -> DataFrame:
    """The mean of the set that the nearest observed row belongs to, on that row's side; sets are those of observed rows around centers."""
    seen, hidden = _split(rows)
    sets, axes = _set_axes(seen, centers)
    near = _near(hidden, seen, 1, found).join(sets, ["net", "other"]).join(axes, "net")
    v = _turned(F.element_at("axes", F.col("set_id")))
    return near.select("net", "id", *(x.alias(f"q{c}") for x, c in zip(v, "xyz")))


def top_two(rows: DataFrame, centers: Centers, k: int = 24, full_share: float = 0.8, second: float = 0.6, found: DataFrame | None = None) -> DataFrame:
    """A mix of the two sets that most of the k nearest observed rows belong to, drawn to the nearest row where the first has few.

    The first set has the share f1 of the votes and the second f2: directions mix by second * f2 / (f1 + f2), and
    the mix counts by f1 / full_share, at most 1, against the nearest row's normal. Equal votes go to the smaller set.
    """
    seen, hidden = _split(rows)
    return _two_mixed(_near(hidden, seen, k, found), seen, centers, full_share, second)


def _two_mixed(found: DataFrame, seen: DataFrame, centers: Centers, full_share: float, second: float) -> DataFrame:
    sets, axes = _set_axes(seen, centers)
    near = found.join(sets, ["net", "other"])
    first = near.filter("rank = 1").select("net", "id", "mx", "my", "mz")
    votes = near.groupBy("net", "id", "set_id").agg(F.count("*").alias("votes")).groupBy("net", "id").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "set_id"))).alias("v"), F.sum("votes").alias("all"))
    met = votes.join(first, ["net", "id"]).join(axes, "net")
    f1 = -F.col("v")[0]["less"] / F.col("all")
    f2 = F.coalesce(-F.get(F.col("v"), F.lit(1))["less"], F.lit(0)) / F.col("all")
    a = _turned(F.element_at("axes", F.col("v")[0]["set_id"]))
    b = _turned(F.element_at("axes", F.coalesce(F.get(F.col("v"), F.lit(1))["set_id"], F.col("v")[0]["set_id"])))
    met = met.withColumns({"t": F.lit(second) * f2 / (f1 + f2), "f": F.least(F.lit(1.0), f1 / full_share)} | {f"a{c}": x for c, x in zip("xyz", a)} | {f"b{c}": x for c, x in zip("xyz", b)})
    mixed = met.withColumns({f"s{c}": F.col(f"a{c}") * (1 - F.col("t")) + F.col(f"b{c}") * F.col("t") for c in "xyz"})
    u = angles.unit(angles.vector("s"), 1e-12)
    drawn = mixed.select("net", "id", *((x * F.col("f") + F.col(f"m{c}") * (1 - F.col("f"))).alias(f"d{c}") for x, c in zip(u, "xyz")))
    return drawn.select("net", "id", *(x.alias(f"q{c}") for x, c in zip(angles.unit(angles.vector("d"), 1e-12), "xyz")))


def fused(parts: list[DataFrame]) -> DataFrame:
    """The mean direction of several predictions of the same rows, each turned to the side of the first."""
    one = parts[0].select("net", "id", *(F.col(f"q{c}").alias(f"r{c}") for c in "xyz"))
    every = parts[0].select("net", "id", "qx", "qy", "qz")
    for p in parts[1:]:
        every = every.unionByName(p.select("net", "id", "qx", "qy", "qz"))
    side = angles.aligned(angles.vector("q"), angles.vector("r"))
    sums = every.join(one, ["net", "id"]).groupBy("net", "id").agg(*(F.sum(s).alias(c) for s, c in zip(side, ("sx", "sy", "sz"))))
    return sums.select("net", "id", *(u.alias(f"q{c}") for u, c in zip(angles.unit(angles.vector("s"), 1e-12), "xyz")))


def truth_assigned(rows: DataFrame, truth: DataFrame, centers: Centers) -> DataFrame:
    """An oracle, no predictor: of the observed rows' sets, the mean that is nearest to a hidden row's true normal."""
    seen, hidden = _split(rows)
    _, axes = _set_axes(seen, centers)
    known = hidden.select("net", "id").join(truth.select("net", "id", "nx", "ny", "nz"), ["net", "id"]).join(axes, "net")
    n = angles.vector()
    best = F.array_max(F.transform(F.map_entries("axes"), lambda e: F.struct(F.abs(n[0] * e["value"]["x"] + n[1] * e["value"]["y"] + n[2] * e["value"]["z"]).alias("s"), (-e["key"]).alias("k"), e["value"].alias("m"))))
    return known.select("net", "id", *(best["m"][c].alias(f"q{c}") for c in "xyz"))


def support(rows: DataFrame, reach: float = 0.5) -> DataFrame:
    """(net, id, dmin, resultant) of hidden rows: how far the nearest observed row is, and how long the mean observed normal within `reach` is, 0 without any.

    Lengths are in units of the net's spread: the mean of the standard deviations of its places along the axes.
    """
    spread = rows.groupBy("net").agg(F.greatest(sum((F.stddev_pop(p) for p in ("px", "py", "pz")), F.lit(0.0)) / 3, F.lit(1e-6)).alias("spread"))
    scaled = rows.join(spread, "net").withColumns({p: F.col(p) / F.col("spread") for p in ("px", "py", "pz")})
    seen, hidden = _split(scaled)
    near = neighbours.nearest(hidden, seen, 1).select("net", "id", F.sqrt("d2").alias("dmin"))
    met = neighbours.within(hidden, seen, reach).join(seen.select("net", F.col("id").alias("other"), "nx", "ny", "nz"), ["net", "other"])
    mean = met.groupBy("net", "id").agg(*(F.avg(f"n{c}").alias(f"s{c}") for c in "xyz")).select("net", "id", angles.length(angles.vector("s")).alias("resultant"))
    return near.join(mean, ["net", "id"], "left").select("net", "id", "dmin", F.coalesce("resultant", F.lit(0.0)).alias("resultant"))


def errors(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """predicted with `error`, the degrees to the true normals (net, id, nx, ny, nz)."""
    got = angles.unit(angles.vector("q"), 1e-12)
    return predicted.join(truth.select("net", "id", "nx", "ny", "nz"), ["net", "id"]).withColumn("error", angles.angle(got, angles.vector()))


def confidence(rows: DataFrame, radius: Column | float = 1.0) -> DataFrame:
    """(net, id, confidence): 1 for observed rows, else 1 less the distance to the nearest observed one over radius."""
    seen, hidden = _split(rows)
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    near = neighbours.nearest(hidden, seen, 1).select("net", "id", (1 - F.least(F.lit(1.0), F.sqrt("d2") / r)).alias("confidence"))
    return near.unionByName(seen.select("net", "id", F.lit(1.0).alias("confidence")))


def blind(rows: DataFrame) -> DataFrame:
    from .quality import hide

    return hide(rows)


def poisoned(rows: DataFrame, seed: int) -> DataFrame:
    """rows whose hidden normals are random unit vectors: a predictor that reads them is found out."""
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    z, a = 2 * u(0) - 1, 2 * 3.141592653589793 * u(1)
    r = F.sqrt(1 - z * z)
    wrong = {"nx": r * F.cos(a), "ny": r * F.sin(a), "nz": z}
    return rows.withColumns({c: F.when(F.col("is_obs"), F.col(c)).otherwise(wrong[c]) for c in wrong})


def evaluate(rows: DataFrame, predictors: dict[str, Predictor]) -> DataFrame:
    """(predictor, net, n, mae, p50, p90) of each predictor on blinded rows."""
    return scored(rows, {name: predictor(blind(rows)) for name, predictor in predictors.items()})


def scored(rows: DataFrame, predicted: dict[str, DataFrame]) -> DataFrame:
    """evaluate() of predictions that are made already: their errors are ranked together, one search for all quantiles."""
    from .aggregates import error_stats

    off = [errors(made, rows).select(F.lit(name).alias("predictor"), "net", "error") for name, made in predicted.items()]
    return error_stats(reduce(DataFrame.unionByName, off), ["predictor", "net"]).select("predictor", "net", "n", "mae", "p50", "p90")


def red_flags(results: DataFrame, baseline: float, floor: float) -> DataFrame:
    """results (predictor, k, mae) with flags: better than the baseline by 2 degrees, within 0.3 of an oracle's floor, or ever better with k."""
    w = Window.partitionBy("predictor").orderBy("k")
    falls = F.coalesce(F.col("mae") < F.lag("mae").over(w), F.lit(True))
    every = F.min(falls.cast("int")).over(Window.partitionBy("predictor")) == 1
    return results.withColumn("too_good", F.col("mae") < baseline - 2).withColumn("near_floor", F.abs(F.col("mae") - floor) < 0.3).withColumn("monotone", every)
