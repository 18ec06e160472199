"""Surfaces of segmented point clouds, the sets they form, and how much fracture area a volume holds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles
from .aggregates import eigen
from .ordered import along_strike, gap_stats
from .tables import written


def _planes(points: DataFrame) -> DataFrame:
    """(net, seg_id, n, cx, cy, cz, nx, ny, nz): center and upward normal of every segment of 3 points or more."""
    p = ("px", "py", "pz")
    moments = [F.covar_pop(p[i], p[j]).alias(f"s{'xyz'[i]}{'xyz'[j]}") for i in range(3) for j in range(i, 3)]
    sums = points.filter("seg_id >= 0").groupBy("net", "seg_id").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c[1]}") for c in p), *moments).filter("n >= 3")
    sums = written(sums, "segments")
    normals = eigen(sums, ["net", "seg_id"]).select("net", "seg_id", *(F.col(f"e3{c}").alias(f"n{c}") for c in "xyz"))
    return sums.select("net", "seg_id", "n", "cx", "cy", "cz").join(normals, ["net", "seg_id"])


def _from_center() -> tuple[Column, Column, Column]:
    return tuple(F.col(f"p{c}") - F.col(f"c{c}") for c in "xyz")


def surfaces(points: DataFrame, least_points: int = 10) -> DataFrame:
    """(net, seg_id, set_id, n_points, cx, cy, cz, nx, ny, nz, area, r_eq, rms) of points (net, px, py, pz, seg_id, set_id).

    Two passes: moments give each segment's center and plane; then how far its points reach in the plane, along and
    across, gives the area of an ellipse, and their distances to it the residual. set_id is what most of its points
    with one (not negative, not null) have, the smallest of equals, or -1. Segments below 0 or null are none; those
    of fewer than least_points (3 at least) are left out. No task holds a segment.
    """
    planes = written(_planes(points), "planes")
    d, n = _from_center(), angles.vector()
    flat = F.abs(F.col("nz")) < 0.9
    ref = tuple(F.when(flat, F.lit(a)).otherwise(F.lit(b)) for a, b in ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0)))
    along = angles.unit(angles.cross(n, ref), 0.0)
    across = angles.cross(n, along)
    met = points.select("net", "seg_id", "px", "py", "pz").join(planes, ["net", "seg_id"])
    u, v, off = angles.dot(d, along), angles.dot(d, across), angles.dot(d, n)
    reach = met.groupBy("net", "seg_id").agg((F.max(u) - F.min(u)).alias("__u"), (F.max(v) - F.min(v)).alias("__v"), F.sqrt(F.avg(off * off)).alias("rms"))
    votes = points.filter("seg_id >= 0 and set_id >= 0").groupBy("net", "seg_id", "set_id").agg(F.count("*").alias("votes"))
    sets = votes.groupBy("net", "seg_id").agg(F.min(F.struct((-F.col("votes")).alias("less"), F.col("set_id").cast("int").alias("set_id"))).alias("b")).select("net", "seg_id", F.col("b.set_id").alias("set_id"))
    area = F.lit(math.pi / 4) * F.col("__u") * F.col("__v")
    out = planes.filter(F.col("n") >= max(3, least_points)).join(reach, ["net", "seg_id"]).join(sets, ["net", "seg_id"], "left")
    return out.select("net", "seg_id", F.coalesce("set_id", F.lit(-1)).alias("set_id"), F.col("n").alias("n_points"), "cx", "cy", "cz", "nx", "ny", "nz", area.alias("area"), F.sqrt(F.greatest(area / math.pi, F.lit(1e-6))).alias("r_eq"), "rms")


def _aligned_means(found: DataFrame, weight: Column, rounds: int) -> DataFrame:
    """(net, set_id, mx, my, mz), upward: weighted means of the surfaces' normals, each on the mean's side, by rounds of sums.

    They start at the weighted mean of the normals as they are, or, where that cancels out, at the normal of most weight.
    """
    rows = written(found.select("net", "set_id", "seg_id", "nx", "ny", "nz", weight.alias("w")), "surface-normals")
    first = rows.groupBy("net", "set_id").agg(*(F.sum(F.col(f"n{c}") * F.col("w")).alias(f"s{c}") for c in "xyz"), F.sum("w").alias("w"), F.max_by(F.struct("nx", "ny", "nz"), F.struct("w", (-F.col("seg_id")).alias("s"))).alias("r"))
    size = angles.length(angles.vector("s"))
    unit = angles.unit(angles.vector("s"), 0.0)
    now = first.select("net", "set_id", *(F.when(size < 1e-8 * F.col("w"), F.col("r")[f"n{c}"]).otherwise(x).alias(f"m{c}") for c, x in zip("xyz", unit)))
    for _ in range(rounds):
        side = angles.aligned(angles.vector(), angles.vector("m"))
        sums = rows.join(now, ["net", "set_id"]).groupBy("net", "set_id").agg(*(F.sum(s * F.col("w")).alias(f"s{c}") for s, c in zip(side, "xyz")), *(F.first(f"m{c}").alias(f"m{c}") for c in "xyz"))
        now = written(sums.select("net", "set_id", *(F.when(size < 1e-12, F.col(f"m{c}")).otherwise(x).alias(f"m{c}") for c, x in zip("xyz", unit))), "surface-means")
    up = F.when(F.col("mz") < 0, -1.0).otherwise(1.0)
    return now.select("net", "set_id", *((F.col(f"m{c}") * up).alias(f"m{c}") for c in "xyz"))


def set_summaries(found: DataFrame, rounds: int = 8) -> DataFrame:
    """(net, set_id, n_surfaces, total_area, total_points, mx, my, mz, dip, dip_dir) of surfaces() that have a set, by area."""
    own = found.filter("set_id >= 0")
    sums = own.groupBy("net", "set_id").agg(F.count("*").alias("n_surfaces"), F.sum("area").alias("total_area"), F.sum("n_points").alias("total_points"))
    m = angles.vector("m")
    return sums.join(_aligned_means(own, F.col("area"), rounds), ["net", "set_id"]).withColumns({"dip": angles.dip(m), "dip_dir": angles.dip_direction(m)})


def surface_spacing(found: DataFrame, rounds: int = 8, noise: float = 1e-3) -> DataFrame:
    """(net, set_id, n, mean, median, p10, p90) of gaps between the centers of a set's surfaces along its strike; sets of two or more."""
    own = found.filter("set_id >= 0")
    axes = _aligned_means(own, F.lit(1.0), rounds)
    placed = own.join(axes, ["net", "set_id"]).select("net", "set_id", "seg_id", *(F.col(f"c{c}").alias(f"p{c}") for c in "xyz"), angles.dip_direction(angles.vector("m")).alias("dip_dir"))
    return gap_stats(along_strike(placed), ["net", "set_id"], "along", "seg_id", noise)


def outcrop_p32(found: DataFrame, points: DataFrame, domain: tuple[float, float, float] | None = None) -> DataFrame:
    """(net, n_surfaces, area, volume, p32): surface area over the domain's volume, or over that of the box around all points."""
    box = (F.max("px") - F.min("px")) * (F.max("py") - F.min("py")) * (F.max("pz") - F.min("pz"))
    volume = F.greatest(box, F.lit(1e-9)) if domain is None else F.lit(float(domain[0] * domain[1] * domain[2]))
    sizes = points.groupBy("net").agg(F.count("*").alias("__n"), volume.alias("volume"))
    sums = found.groupBy("net").agg(F.count("*").alias("n_surfaces"), F.sum("area").alias("area"))
    out = sizes.join(sums, "net", "left").select("net", F.coalesce("n_surfaces", F.lit(0).cast("long")).alias("n_surfaces"), F.coalesce("area", F.lit(0.0)).alias("area"), "volume")
    return out.withColumn("p32", F.col("area") / F.col("volume"))


def segment_quality(points: DataFrame) -> DataFrame:
    """(net, seg_id, n, residual): mean distance of each segment's points to its plane; null below 3 points, and for points of none (-1)."""
    sizes = points.groupBy("net", F.coalesce(F.when(F.col("seg_id") >= 0, F.col("seg_id")), F.lit(-1)).alias("seg_id")).agg(F.count("*").alias("n"))
    planes = written(_planes(points), "planes")
    off = F.abs(angles.dot(_from_center(), angles.vector()))
    residual = points.select("net", "seg_id", "px", "py", "pz").join(planes, ["net", "seg_id"]).groupBy("net", "seg_id").agg(F.avg(off).alias("residual"))
    return sizes.join(residual, ["net", "seg_id"], "left")
