"""Sums over sets of planes: set tables, dispersion, scatter, intensity, agreement of labels, errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles, grades
from .tables import written

Center = tuple[float, float, float]


def assign(rows: DataFrame, centers: list[Center]) -> DataFrame:
    """rows (nx, ny, nz) with set_id of the nearest center and `angle` to it in degrees. Centers are few."""
    best = angles.nearest_center(angles.vector(), centers)
    return (
        rows.withColumn("__b", best)
        .withColumn("set_id", F.col("__b.k"))
        .withColumn("angle", F.degrees(F.acos(F.least(F.lit(1.0), F.col("__b.similarity")))))
        .drop("__b")
    )


def set_dispersion(assigned: DataFrame, by: list[str]) -> DataFrame:
    """By group and set: n, proportion, mean and largest angle, whether n is enough for statistics (3)."""
    counts = assigned.groupBy(*by, "set_id").agg(F.count("*").alias("n"), F.avg("angle").alias("mean_angle"), F.max("angle").alias("max_angle"))
    all_n = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("proportion", F.col("n") / all_n).withColumn("statistical", F.col("n") >= 3)


def set_means(rows: DataFrame, by: list[str], reference: DataFrame) -> DataFrame:
    """(by, mx, my, mz): unit mean of the normals, each turned to the side of its set's reference rx, ry, rz."""
    turned = angles.aligned(angles.vector(), angles.vector("r"))
    sums = rows.join(reference, by).select(*by, *(t.alias(c) for t, c in zip(turned, ("sx", "sy", "sz")))).groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("sx", "sy", "sz")))
    mean = angles.unit(angles.vector("s"), 0.0)
    return sums.select(*by, *(m.alias(c) for m, c in zip(mean, ("mx", "my", "mz"))))


def set_table(rows: DataFrame, by: list[str], centers: list[Center]) -> DataFrame:
    """(by, set_id, n, proportion, mx, my, mz, mean_angle, kappa, dip, dip_dir, strike).

    Rows go to the nearest center; a set's center is then the mean of its rows, and its spread their mean angle
    to that mean. Two sums over the rows, whatever the number of sets.
    """
    keys = [*by, "set_id"]
    assigned = assign(rows, centers)
    ref = F.array(*(F.struct(*(F.lit(float(x)).alias(c) for x, c in zip(v, ("rx", "ry", "rz")))) for v in centers))
    turned = assigned.withColumn("__r", F.get(ref, F.col("set_id"))).withColumns({c: F.col(f"__r.{c}") for c in ("rx", "ry", "rz")})
    side = angles.aligned(angles.vector(), angles.vector("r"))
    sums = turned.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(s).alias(c) for s, c in zip(side, ("sx", "sy", "sz"))))
    mean = angles.unit(angles.vector("s"), 0.0)
    # written, so that a few means are broadcast and the rows not shuffled by a few keys
    means = written(sums.select(*keys, "n", *(m.alias(c) for m, c in zip(mean, ("mx", "my", "mz")))), "set-means")
    spread = assigned.drop("angle").join(means.drop("n"), keys).groupBy(*keys).agg(F.avg(angles.angle(angles.vector(), angles.vector("m"))).alias("mean_angle"))
    out = means.join(spread, keys).withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    m = angles.vector("m")
    return out.withColumn("kappa", grades.set_kappa(F.col("mean_angle"))).withColumn("dip", angles.dip(m)).withColumn("dip_dir", angles.dip_direction(m)).withColumn("strike", angles.strike(F.col("dip_dir")))


def terzaghi(rows: DataFrame, by: list[str], axis: Center = (0.0, 0.0, 1.0), lo: float = 0.1, hi: float = 5.0) -> DataFrame:
    """rows with weight w: the raw weight over its group's mean, then held between lo and hi; and w_clipped."""
    raw = angles.raw_terzaghi(angles.vector(), angles.literal(axis))
    mean = rows.withColumn("__raw", raw).groupBy(*by).agg(F.avg("__raw").alias("__mean"))
    scaled = rows.join(mean, by).withColumn("__s", raw / F.col("__mean"))
    return scaled.withColumn("w", F.least(F.lit(hi), F.greatest(F.lit(lo), F.col("__s")))).withColumn("w_clipped", (F.col("__s") < lo) | (F.col("__s") > hi)).drop("__s", "__mean")


def effective_size(weighted: DataFrame, by: list[str]) -> DataFrame:
    """By group: n, effective sample size of the weights, their extremes, and how many were held."""
    return weighted.groupBy(*by).agg(
        F.count("*").alias("n"),
        (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"),
        F.avg("w").alias("w_mean"),
        F.min("w").alias("w_min"),
        F.max("w").alias("w_max"),
        F.count(F.when(F.col("w_clipped"), 1)).alias("n_clipped"),
    )


def scatter(rows: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """By group: the six sums of weighted products of normals over the sum of weights (sxx ... szz)."""
    w = F.lit(1.0) if weight is None else weight
    n = dict(zip("xyz", angles.vector()))
    sums = [(F.sum(w * n[a] * n[b]) / F.sum(w)).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return rows.groupBy(*by).agg(*sums)


def eigen(moments: DataFrame, by: list[str]) -> DataFrame:
    """by, eigenvalues l1 >= l2 >= l3, and the first and last eigenvectors (e1x.., e3x..), upward, of scatter()."""
    names = ["l1", "l2", "l3", "e1x", "e1y", "e1z", "e3x", "e3y", "e3z"]

    def solve(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            xx, xy, xz, yy, yz, zz = (pdf[f"s{k}"].to_numpy() for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
            m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
            values, vectors = np.linalg.eigh(m)
            first, last = vectors[:, :, 2], vectors[:, :, 0]
            up = lambda v: v * np.where(v[:, 2:] < 0, -1.0, 1.0)
            got = np.concatenate([values[:, ::-1], up(first), up(last)], axis=1)
            yield pd.concat([pdf[by].reset_index(drop=True), pd.DataFrame(got, columns=names)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in moments.schema}
    return moments.mapInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + ", ".join(f"{c} double" for c in names))


def kappa(rows: DataFrame, by: list[str]) -> DataFrame:
    """By group: r, the mean absolute cosine to the center (mx, my, mz), and the concentration from it."""
    r = rows.groupBy(*by).agg(F.avg(F.abs(angles.dot(angles.vector(), angles.vector("m")))).alias("r"))
    return r.withColumn("kappa", angles.kappa_from_resultant(F.col("r")))


def intensity(rows: DataFrame, by: list[str]) -> DataFrame:
    """By well: n, depth range, planes per length p10, and area per volume p32 = pi * p10 for an isotropic set."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.max("depth") - F.min("depth")).alias("depth_range"))
    return out.withColumn("p10", F.when(F.col("depth_range") > 0, F.col("n") / F.col("depth_range"))).withColumn("p32", F.col("p10") * F.lit(np.pi))


def power_law(rows: DataFrame, by: list[str], size: str, r_min: float, r_max: float) -> DataFrame:
    """By group: n, x_min, beta by maximum likelihood and its standard error.

    Sizes from a tenth of r_min to twice r_max count; x_min is the larger of half r_min and the smallest. beta
    lies between 1.5 and 5; groups of fewer than 10 sizes, or without spread, get 3.5 and no error.
    """
    x = F.col(size)
    kept = rows.filter(x.between(0.1 * r_min, 2 * r_max))
    least = kept.groupBy(*by).agg(F.greatest(F.lit(0.5 * r_min), F.min(x)).alias("x_min"))
    sums = kept.join(least, by).filter(x >= F.col("x_min")).groupBy(*by).agg(F.count("*").alias("n"), F.first("x_min").alias("x_min"), F.sum(F.log(x / F.col("x_min"))).alias("__s"))
    enough = (F.col("n") >= 10) & (F.col("__s") > 0)
    raw = 1 + F.col("n") / F.col("__s")
    beta = F.when(enough, F.least(F.lit(5.0), F.greatest(F.lit(1.5), raw))).otherwise(F.lit(3.5))
    return sums.withColumn("beta", beta).withColumn("beta_se", F.when(enough, (raw - 1) / F.sqrt("n"))).drop("__s")


def rand_index(labels: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, ari): agreement of two labellings, by one pass over grouping sets."""
    rows = labels.select(*by, F.col(a).alias("__a"), F.col(b).alias("__b"))
    keys = [F.col(c) for c in by]
    sets = [[*keys, F.col("__a"), F.col("__b")], [*keys, F.col("__a")], [*keys, F.col("__b")], keys]
    counts = rows.groupingSets(sets, *keys, "__a", "__b").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    part = lambda g: F.sum(F.when(F.col("g") == g, pairs).otherwise(F.lit(0.0)))
    sums = counts.groupBy(*by).agg(part(0).alias("ab"), part(1).alias("a"), part(2).alias("b"), part(3).alias("all"), F.max("n").alias("n"))
    expected = F.col("a") * F.col("b") / F.col("all")
    top, bottom = F.col("ab") - expected, (F.col("a") + F.col("b")) / 2 - expected
    ari = F.when(F.col("n") < 2, 0.0).when(F.abs(bottom) < 1e-12, F.when(F.abs(top) < 1e-12, 1.0).otherwise(0.0)).otherwise(top / bottom)
    return sums.select(*by, "n", ari.alias("ari"))


def error_stats(errors: DataFrame, by: list[str], error: str = "error") -> DataFrame:
    """By group: n, mean, and interpolated percentiles 50 and 90 of an error."""
    from .order import with_quantiles

    return with_quantiles(errors.groupBy(*by).agg(F.count("*").alias("n"), F.avg(error).alias("mae")), errors, by, error, {"p50": 0.5, "p90": 0.9})


def two_level_mean(errors: DataFrame, outer: str, inner: str, error: str = "error") -> DataFrame:
    """One row: mean over `outer` of the mean over `inner` of the mean error, and its spread over outer."""
    first = errors.groupBy(outer, inner).agg(F.avg(error).alias("e"))
    second = first.groupBy(outer).agg(F.avg("e").alias("e"))
    return second.agg(F.count("*").alias("n"), F.avg("e").alias("mae_mean"), F.coalesce(F.stddev_samp("e"), F.lit(0.0)).alias("mae_std"))


def rank_correlation(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, rho): Spearman's correlation, equal values sharing their mean rank; pairs with a null don't count."""
    from .order import rank_correlations

    return rank_correlations(rows, by, x, [y]).select(*by, "n", "rho")


def bootstrap_cone(rows: DataFrame, by: list[str], resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(by, n, cone): means.bootstrap_cone(), the angle that holds `level` of resampled intrinsic means."""
    from . import means

    return means.bootstrap_cone(rows, by, resamples, level, seed)


def axis_deviation(rows: DataFrame, by: list[str], prefix: str = "n", reference: Center = (0.0, 0.0, 1.0)) -> DataFrame:
    """(by, deviation): the largest angle of a group's undirected unit vectors to a reference."""
    return rows.groupBy(*by).agg(F.max(angles.angle(angles.vector(prefix), angles.literal(reference))).alias("deviation"))


def stratified(errors: DataFrame, anisotropy: str = "anisotropy") -> DataFrame:
    """(tier, n, mae, p50) of errors by tiers of anisotropy: high from 0.5, middle from 0.25, else low."""
    told = errors.withColumn("tier", grades.anisotropy_tier(F.col(anisotropy)))
    from .order import with_quantiles

    return with_quantiles(told.groupBy("tier").agg(F.count("*").alias("n"), F.avg("error").alias("mae")), told, ["tier"], "error", {"p50": 0.5})


def usable_nets(rows: DataFrame, by: list[str], least_seen: int = 2) -> DataFrame:
    """(by, n_seen, n_hidden) of groups that can be evaluated: least_seen observed rows or more, and a hidden one."""
    counts = rows.groupBy(*by).agg(F.count(F.when(F.col("is_obs"), 1)).alias("n_seen"), F.count(F.when(~F.col("is_obs"), 1)).alias("n_hidden"))
    return counts.filter((F.col("n_seen") >= least_seen) & (F.col("n_hidden") > 0))
