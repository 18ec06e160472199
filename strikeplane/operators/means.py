"""Intrinsic means and medians of undirected normals by rounds of sums, and how far resampled means lie from them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles
from .aggregates import eigen, scatter
from .tables import written


def _flat(rows: DataFrame, by: list[str], weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return written(rows.select(*by, "nx", "ny", "nz", w.alias("w")).dropna().filter("w > 0"), "normals")


def _principal(points: DataFrame, by: list[str]) -> DataFrame:
    axes = eigen(scatter(points, by, F.col("w")), by)
    return axes.select(*by, *(F.col(f"e1{c}").alias(f"m{c}") for c in "xyz"))


def _rounds(points: DataFrame, by: list[str], start: DataFrame, terms: list[Column], moved: list[Column], rounds: int, tolerance: float) -> DataFrame:
    """(by, mx, my, mz) after rounds of sums of terms (columns of n, m and w, as tx, ty, tz) and of the move they give."""
    now, m = start, angles.vector("m")
    for _ in range(rounds):
        sums = points.join(now, by).groupBy(*by).agg(*(F.sum(t).alias(c) for t, c in zip(terms, ("tx", "ty", "tz"))), F.sum("w").alias("total"), *(F.first(c).alias(c) for c in ("mx", "my", "mz")))
        new = angles.unit(tuple(moved), 0.0)
        told = sums.select(*by, *(c.alias(f"u{x}") for x, c in zip("xyz", new)), "mx", "my", "mz")
        step = angles.angle(angles.vector("u"), m)
        now = written(told.select(*by, *(F.col(f"u{x}").alias(f"m{x}") for x in "xyz"), step.alias("step")), "means")
        if (now.agg(F.max("step")).first()[0] or 0.0) <= np.degrees(tolerance):
            break
        now = now.drop("step")
    return now.drop("step")


def frechet_means(rows: DataFrame, by: list[str], weight: str | None = None, start: DataFrame | None = None, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(by, mx, my, mz): the undirected direction of least weighted sum of squared angles to each group's normals.

    A round maps all normals to the tangent plane at the mean (each on the mean's side), sums them there, and moves
    the mean by their weighted mean; it is one sum over the rows, whatever a group's size. Rounds go on until no mean
    moves by more than tolerance (radians). The start is each group's principal axis, or start (by, mx, my, mz). Rows
    without a normal, or with a weight of 0 or none, don't count; a group without others has no row.
    """
    points = _flat(rows, by, weight)
    n, m = angles.vector(), angles.vector("m")
    dot = angles.dot(n, m)
    c = F.least(F.lit(1.0), F.abs(dot))
    s = F.sqrt(1 - c * c)
    stretch = F.when(s > 1e-8, F.acos(c) / s).otherwise(F.lit(0.0)) * F.col("w")
    terms = [stretch * (x * angles.sign(dot) - c * y) for x, y in zip(n, m)]
    t = tuple(F.col(x) / F.col("total") for x in ("tx", "ty", "tz"))
    size = angles.length(t)
    moved = [y * F.cos(size) + F.when(size > 0, x / size * F.sin(size)).otherwise(F.lit(0.0)) for x, y in zip(t, m)]
    return _rounds(points, by, start if start is not None else _principal(points, by), terms, moved, rounds, tolerance)


def median_directions(rows: DataFrame, by: list[str], weight: str | None = None, rounds: int = 40, tolerance: float = 1e-7, eps: float = 1e-3) -> DataFrame:
    """(by, mx, my, mz): the undirected direction of least weighted sum of angles to each group's normals.

    As frechet_means(), but every round is a mean weighted by one over the sine of the angle, of at least eps.
    """
    points = _flat(rows, by, weight)
    n, m = angles.vector(), angles.vector("m")
    dot = angles.dot(n, m)
    pull = F.col("w") * angles.sign(dot) / F.sqrt(F.greatest(1 - dot * dot, F.lit(eps * eps)))
    moved = [F.col(c) for c in ("tx", "ty", "tz")]
    return _rounds(points, by, _principal(points, by), [pull * x for x in n], moved, rounds, tolerance)


#: Odds that a Poisson number of mean 1 is at most 0, 1, 2, ...: beyond 24 they differ from 1 by less than a double tells.
_POISSON = np.cumsum([np.exp(-1)] + [np.exp(-1) / float(np.prod(np.arange(1, i + 1, dtype=float))) for i in range(1, 24)])


def _times(keys: np.ndarray, resamples: int) -> np.ndarray:
    """How often each row enters each resample: Poisson numbers of mean 1, by the row's key."""
    h = keys.view(np.uint64)[:, None] + np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    times = np.zeros(u.shape, dtype=np.uint8)
    for odds in _POISSON:  # most numbers are small, so few of these steps find any
        above = u >= odds
        if not above.any():
            break
        times += above
    return times.astype(float)


def _tangents(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors at right angles to each row of m and each other."""
    least = np.eye(3)[np.abs(m).argmin(axis=1)]
    a = np.cross(m, least)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    return a, np.cross(m, a)


def _features(n: np.ndarray, m: np.ndarray, w: np.ndarray, intrinsic: bool) -> np.ndarray:
    """What a resample sums of each row: the normal on the mean's side, or the slope and curvature of half the squared angle at the mean."""
    dot = (n * m).sum(axis=1)
    n = n * np.where(dot < 0, -1.0, 1.0)[:, None]
    if not intrinsic:
        return n * w[:, None]
    a, b = _tangents(m)
    c = np.clip(np.abs(dot), 0, 1)
    s = np.sqrt(1 - c * c)
    theta = np.arccos(c)
    wide = s > 1e-8
    stretch = np.where(wide, theta / np.where(wide, s, 1), 1.0)
    x, y = stretch * (n * a).sum(axis=1), stretch * (n * b).sum(axis=1)
    across = np.where(wide, theta * c / np.where(wide, s, 1), 1.0)
    ux, uy = np.where(wide, x / np.where(theta > 0, theta, 1), 1.0), np.where(wide, y / np.where(theta > 0, theta, 1), 0.0)
    return np.stack([x, y, ux * ux + across * (1 - ux * ux), (1 - across) * ux * uy, uy * uy + across * (1 - uy * uy)], axis=1) * w[:, None]


def _offsets(sums: np.ndarray, m: np.ndarray, intrinsic: bool) -> np.ndarray:
    """Angles in degrees of the resamples' means to the mean."""
    if not intrinsic:
        size = np.linalg.norm(sums, axis=1)
        c = np.abs(sums @ m) / np.where(size > 0, size, 1)
        return np.where(size > 0, np.degrees(np.arccos(np.clip(c, 0, 1))), 0.0)
    gx, gy, hxx, hxy, hyy = sums.T
    det = hxx * hyy - hxy * hxy
    fine = det > 1e-12 * np.maximum(1e-300, hxx + hyy) ** 2
    det = np.where(fine, det, 1.0)
    dx, dy = (hyy * gx - hxy * gy) / det, (hxx * gy - hxy * gx) / det
    return np.where(fine, np.minimum(90.0, np.degrees(np.hypot(dx, dy))), np.where(np.hypot(gx, gy) > 0, 90.0, 0.0))


#: Rows of one part of a group whose resamples are summed in one task.
_PART = 65536


def _resampled_angles(sums: np.ndarray, m: np.ndarray, intrinsic: bool, level: float) -> tuple[float, float, float]:
    off = _offsets(sums, m, intrinsic)
    rest = (1 - level) / 2
    return tuple(float(q) for q in np.quantile(off, (level, rest, 1 - rest)))


def resampled(rows: DataFrame, by: list[str], resamples: int = 200, level: float = 0.95, seed: int = 0, intrinsic: bool = True, weight: str | None = None) -> DataFrame:
    """(by, n, cone, low, high): angles between each group's mean (mx, my, mz of its rows) and the means of resamples of its rows.

    cone covers `level` of them, low and high are the quantiles that leave half of the rest out on either side. A row
    enters each resample as often as a Poisson number says that follows from its row_id and the seed. Rows of a group
    lie together, a large group's in parts of about _PART rows: a task sums the resamples of one group after the
    other, and only parts of large groups leave it as sums. So what is shuffled is the rows, once, and one array for
    each _PART rows of large groups, however many groups or resamples there are. Intrinsic means are found from the
    sums of slopes and curvatures at the group's own mean, which differ from theirs by the square of the angle between them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    width = 5 if intrinsic else 3
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    flat = rows.select(*by, "nx", "ny", "nz", "mx", "my", "mz", w.alias("w"), F.xxhash64("row_id", F.lit(seed)).alias("key")).dropna(subset=["nx", "ny", "nz", "mx", "my", "mz", "w"])
    sizes = flat.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > _PART)
    large = written(sizes.select(*(F.col(c).alias(f"__{c}") for c in by), F.ceil(F.col("__n") / _PART).cast("int").alias("parts")), "large-groups")
    same = reduce(lambda a, x: a & x, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    met = flat.join(large, same, "left").drop(*(f"__{c}" for c in by)).withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = met.withColumn("part", F.pmod(F.col("key"), F.col("parts")).cast("int")).repartition(*by, "part").sortWithinPartitions(*by, "part")
    held = [*by, "part"]

    def summed(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*by, "n", "cone", "low", "high", "m", "sums"]
        last: tuple | None = None
        got: list = []

        for pdf in found:
            out = []
            n, m = pdf[["nx", "ny", "nz"]].to_numpy(float), pdf[["mx", "my", "mz"]].to_numpy(float)
            made, keys, parts = _features(n, m, pdf["w"].to_numpy(float), intrinsic), pdf["key"].to_numpy(), pdf["parts"].to_numpy()
            told = pdf[held].astype(object).where(pdf[held].notna(), None)
            codes = pdf.groupby(held, dropna=False, sort=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(pdf) else []
            for a, z in zip(starts, [*starts[1:], len(pdf)]):
                k = tuple(told.iloc[a])
                if last is None or k != last[2]:
                    if last is not None:
                        out.append((*last[0], *_closed(last, got, intrinsic, level)))
                    last, got = (k[:-1], int(parts[a]), k), [0, np.zeros((resamples, width)), m[a]]
                got[0] += int(z - a)
                for first in range(a, z, 2048):
                    to = min(first + 2048, z)
                    got[1] += _times(keys[first:to], resamples).T @ made[first:to]
            yield pd.DataFrame(out, columns=names)
        if last is not None:
            yield pd.DataFrame([(*last[0], *_closed(last, got, intrinsic, level))], columns=names)

    group = ", ".join(f"{c} {kinds[c]}" for c in by)
    parts = written(dealt.mapInPandas(summed, group + ", n long, cone double, low double, high double, m array<double>, sums array<double>"), "resampled")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum(np.stack([np.asarray(x, float) for x in pdf["sums"]]), axis=0).reshape(resamples, width)
        cone, low, high = _resampled_angles(sums, np.asarray(pdf["m"].iloc[0], float), intrinsic, level)
        return pdf[by].iloc[:1].assign(n=int(pdf["n"].sum()), cone=cone, low=low, high=high)

    whole = parts.filter("sums IS NULL").select(*by, "n", "cone", "low", "high")
    return whole.unionByName(parts.filter("sums IS NOT NULL").groupBy(*by).applyInPandas(joined, group + ", n long, cone double, low double, high double"))


def _closed(last: tuple, got: list, intrinsic: bool, level: float) -> tuple:
    """What resampled() tells of a group or of a part of one: n, its angles or none, and then its mean and sums."""
    n, sums, m = got
    if last[1] > 1:
        return n, None, None, None, m, sums.ravel()
    return n, *_resampled_angles(sums, m, intrinsic, level), None, None


def bootstrap_cone(rows: DataFrame, by: list[str], resamples: int = 200, level: float = 0.95, seed: int = 0, weight: str | None = None) -> DataFrame:
    """(by, n, cone): the angle around each group's intrinsic mean that holds `level` of its resamples' intrinsic means.

    rows need row_id and a normal. Groups below 3 rows have 180.
    """
    means = frechet_means(rows, by, weight)
    told = resampled(rows.drop("mx", "my", "mz").join(means, by), by, resamples, level, seed, True, weight)
    return told.select(*by, "n", F.when(F.col("n") < 3, 180.0).otherwise(F.col("cone")).alias("cone"))


def modal_interval(rows: DataFrame, by: list[str], resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(by, n, mx, my, mz, ci_low, ci_high, ci_half_width): each group's mean direction and the interval of angles to it of resampled ones.

    The mean is that of the normals on the side of the principal axis. A group of one row has zeros.
    """
    axes = _principal(_flat(rows, by, None), by)
    side = angles.aligned(angles.vector(), angles.vector("m"))
    bare = rows.drop("mx", "my", "mz")
    sums = bare.join(axes, by).groupBy(*by).agg(*(F.sum(s).alias(c) for s, c in zip(side, ("sx", "sy", "sz"))))
    means = written(sums.select(*by, *(u.alias(f"m{c}") for u, c in zip(angles.unit(angles.vector("s"), 0.0), "xyz"))), "modal")
    told = resampled(bare.join(means, by), by, resamples, level, seed, False).join(means, by)
    one = F.col("n") < 2
    return told.select(*by, "n", "mx", "my", "mz", F.when(one, 0.0).otherwise(F.col("low")).alias("ci_low"), F.when(one, 0.0).otherwise(F.col("high")).alias("ci_high"), F.when(one, 0.0).otherwise(F.col("high")).alias("ci_half_width"))


def fisher_fit(rows: DataFrame, by: list[str], most: float = 1000.0) -> DataFrame:
    """(by, n, mx, my, mz, r, kappa): mean direction and concentration of directed unit vectors, by maximum likelihood.

    kappa solves coth(kappa) - 1 / kappa = r, the length of the mean vector, up to `most`, and is then lowered by
    n / (n + 2.5), as small groups look too concentrated. A group of one row has the vertical and 0; one whose vectors
    cancel out has 0. One sum over the rows.
    """
    sums = rows.dropna(subset=["nx", "ny", "nz"]).groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(f"n{c}").alias(f"s{c}") for c in "xyz"))
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}

    def solved(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            s, n = pdf[["sx", "sy", "sz"]].to_numpy(float), pdf["n"].to_numpy()
            r = np.linalg.norm(s, axis=1)
            low, high = np.full(len(r), 1e-6), np.full(len(r), most)
            for _ in range(80):
                k = (low + high) / 2
                under = 1 / np.tanh(k) - 1 / k < r
                low, high = np.where(under, k, low), np.where(under, high, k)
            none = (r < 1e-6) | (n < 2)
            unit = np.where((n < 2)[:, None], [0.0, 0.0, 1.0], s / np.maximum(r, 1e-12)[:, None])
            yield pdf[[*by, "n"]].assign(mx=unit[:, 0], my=unit[:, 1], mz=unit[:, 2], r=r, kappa=np.where(none, 0.0, (low + high) / 2 * n / (n + 2.5)))

    return sums.mapInPandas(solved, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, mx double, my double, mz double, r double, kappa double")
