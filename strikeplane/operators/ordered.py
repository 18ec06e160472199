"""Operators along depth or along a curve: windows with explicit frames and a row id to break ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles


def gaps(log: DataFrame, by: list[str], along: str, tie: str, noise: float = 0.0) -> DataFrame:
    """Rows with `gap` to the row before in their group, those of more than noise."""
    w = Window.partitionBy(*by).orderBy(along, tie)
    return log.withColumn("gap", F.col(along) - F.lag(along).over(w)).filter(F.col("gap") > noise)


def gap_stats(log: DataFrame, by: list[str], along: str, tie: str, noise: float = 0.0) -> DataFrame:
    """By group: n, mean, median and percentiles 10 and 90 of the gaps."""
    return gaps(log, by, along, tie, noise).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("gap").alias("mean"),
        F.percentile("gap", 0.5).alias("median"),
        F.percentile("gap", 0.1).alias("p10"),
        F.percentile("gap", 0.9).alias("p90"),
    )


def along_strike(rows: DataFrame) -> DataFrame:
    """rows (px, py, pz, dip_dir) with `along`: where their center lies on their set's strike line."""
    s = angles.strike_vector(F.col("dip_dir"))
    return rows.withColumn("along", angles.dot(angles.vector("p"), s))


def trajectory(stations: DataFrame, by: list[str], depth: str = "md", tie: str = "row_id") -> DataFrame:
    """stations (md, hazi, hdev in degrees) with east, north, up of the path, 0 at a well's first station.

    Each step follows the mean of the angles at its ends.
    """
    w = Window.partitionBy(*by).orderBy(depth, tie)
    step = F.coalesce(F.col(depth) - F.lag(depth).over(w), F.lit(0.0))
    azimuth = F.radians((F.col("hazi") + F.coalesce(F.lag("hazi").over(w), F.col("hazi"))) / 2)
    off = F.radians((F.col("hdev") + F.coalesce(F.lag("hdev").over(w), F.col("hdev"))) / 2)
    moved = stations.withColumns({"__e": step * F.sin(off) * F.sin(azimuth), "__n": step * F.sin(off) * F.cos(azimuth), "__u": -step * F.cos(off)})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return moved.withColumns({name: F.sum(c).over(so_far) for name, c in (("east", "__e"), ("north", "__n"), ("up", "__u"))}).drop("__e", "__n", "__u")


def tangents(path: DataFrame, by: list[str], depth: str = "md", tie: str = "row_id") -> DataFrame:
    """path (east, north, up) with the unit tangent tx, ty, tz by central differences, one-sided at the ends."""
    w = Window.partitionBy(*by).orderBy(depth, tie)
    d = tuple(F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in ("east", "north", "up"))
    with_d = path.withColumns(dict(zip(("__x", "__y", "__z"), d)))
    t = angles.unit(angles.vector("__"), 1e-12)
    return with_d.withColumns(dict(zip(("tx", "ty", "tz"), t))).drop("__x", "__y", "__z")


def crossing(curve: DataFrame, by: list[str], x: str, y: str, target: float) -> DataFrame:
    """(by, at): where an ordered curve first reaches target, by linear interpolation.

    A curve that begins at or above it gives its first x, one that never reaches it its last.
    """
    w = Window.partitionBy(*by).orderBy(x)
    before_x, before_y = F.lag(x).over(w), F.lag(y).over(w)
    steps = curve.withColumn("__bx", before_x).withColumn("__by", before_y)
    inside = (F.col("__by") < target) & (F.col(y) >= target)
    at = F.col("__bx") + (target - F.col("__by")) * (F.col(x) - F.col("__bx")) / (F.col(y) - F.col("__by"))
    return steps.groupBy(*by).agg(
        F.coalesce(
            F.when(F.min_by(y, x) >= target, F.min(x)),
            F.min(F.when(inside, at)),
            F.max(x),
        ).alias("at")
    )
