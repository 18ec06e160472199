"""Planes in point clouds by RANSAC, with refit: every score is a sum that Spark takes over all points of a cloud."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles
from .neighbours import knn_scale, local_planes
from .tables import written

_PLANE = ("ax", "ay", "az", "ux", "uy", "uz")
_AXES = ("xx", "xy", "xz", "yy", "yz", "zz")
#: Points of one part of a cloud; planes meet the points part by part, so a large cloud is many tasks.
_PART = 65536
#: Points that meet all tries at once in a task.
_CHUNK = 512
#: Points of least hash among which the corner of a try is looked for, on average.
_DRAWN = 64


def least_inliers(n: Column, wanted: int) -> Column:
    """wanted for a cloud of at least 50 times as many points, else a tenth of its points, three at least."""
    return F.when(n >= 50 * wanted, F.lit(wanted)).otherwise(F.greatest(F.lit(3), F.floor(n / 10))).cast("long")


def _off(prefix: str = "") -> Column:
    """Distance of a point (px, py, pz) from the plane through a with unit normal u."""
    return F.abs(sum(((F.col(f"p{c}") - F.col(f"{prefix}a{c}")) * F.col(f"{prefix}u{c}") for c in "xyz"), F.lit(0.0)))


def _spread(planes: DataFrame, clouds: DataFrame) -> DataFrame:
    """planes once for each part of their cloud; clouds has net and parts."""
    return planes.join(clouds.select("net", "parts"), "net").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _proposals(left: DataFrame, sizes: DataFrame, tries: int, seed: int) -> DataFrame:
    """(net, h, plane): for each cloud up to `tries` planes through three of its points that no plane holds yet.

    Each corner of try h is the point of least hash among those whose hash falls to h, so three points of every try
    are drawn by one aggregation. It sorts its points, so of a large cloud only those come to it whose hash is among
    the least: _DRAWN of a try on average, and none with odds of exp(-_DRAWN). sizes has net and m, the points left.
    Points in one line make no plane.
    """
    drawn, known = None, left.join(sizes, "net")
    limit = -(2.0**63) + 2.0**64 * F.least(F.lit(1.0), F.lit(float(_DRAWN * tries)) / F.col("m"))
    for corner in range(3):
        key = F.xxhash64("id", F.lit(seed), F.lit(corner))
        one = known.filter(key.cast("double") <= limit).groupBy("net", F.pmod(key, F.lit(tries)).cast("int").alias("h")).agg(F.min_by(F.struct("px", "py", "pz"), F.struct(key.alias("key"), F.col("id"))).alias(f"c{corner}"))
        drawn = one if drawn is None else drawn.join(one, ["net", "h"])
    edge = lambda i: tuple(F.col(f"c{i}.p{c}") - F.col(f"c0.p{c}") for c in "xyz")
    normal = angles.cross(edge(1), edge(2))
    crossed = drawn.select("net", "h", *(F.col(f"c0.p{c}").alias(f"a{c}") for c in "xyz"), *(x.alias(f"m{c}") for x, c in zip(normal, "xyz"))).filter(angles.length(angles.vector("m")) > 1e-12)
    return crossed.select("net", "h", "ax", "ay", "az", *(x.alias(f"u{c}") for x, c in zip(angles.unit(angles.vector("m"), 0.0), "xyz")))


def _fitted(points: DataFrame, by: list[str]) -> DataFrame:
    """by, ax .. az, fx .. fz: the mean place of each group and the normal of its plane; three points or more that do not lie in one line."""
    from .aggregates import eigen

    moments = points.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(f"p{c}").alias(f"a{c}") for c in "xyz"), *(F.covar_pop(f"p{a}", f"p{b}").alias(f"s{a}{b}") for a, b in _AXES)).filter("n >= 3")
    flat = eigen(moments, by).filter("l1 > 0 AND l2 > 1e-12 * l1").select(*by, *(F.col(f"e3{c}").alias(f"f{c}") for c in "xyz"))
    return flat.join(moments.select(*by, "ax", "ay", "az"), by)


def _inliers(points: DataFrame, tried: DataFrame, clouds: DataFrame) -> DataFrame:
    """(net, h, n): how many points lie within their tolerance of each plane tried, of planes with any.

    A part of a cloud meets the planes tried on it in one task, some thousand points at a time; what leaves the task is
    a count for each plane, so no row is made for a point and a plane.
    """

    def count(part: pd.DataFrame, planes: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(planes), dtype=np.int64)
        places, tol = [part[f"p{c}"].to_numpy() for c in "xyz"], part["tol"].to_numpy()
        at, up = ([planes[f"{k}{c}"].to_numpy() for c in "xyz"] for k in "au")
        room, less = np.empty((2, _CHUNK, len(planes))), np.empty((_CHUNK, len(planes)), dtype=bool)
        for first in range(0, len(part) if len(planes) else 0, _CHUNK):
            rows = slice(first, min(first + _CHUNK, len(part)))
            (x, off), near = room[:, : rows.stop - first], less[: rows.stop - first]  # arrays are kept, as new ones cost more than the sums
            off[:] = 0.0
            for p, a, u in zip(places, at, up):
                np.subtract(p[rows, None], a, out=x)
                x *= u
                off += x
            np.less(np.abs(off, out=off), tol[rows, None], out=near)
            n += np.count_nonzero(near, axis=0)
        return pd.DataFrame({"net": planes["net"], "h": planes["h"], "n": n})[n > 0]

    kinds = {f.name: f.dataType.simpleString() for f in tried.schema}
    parts = points.select("net", "part", "px", "py", "pz", "tol").groupBy("net", "part")
    told = parts.cogroup(_spread(tried, clouds).groupBy("net", "part")).applyInPandas(count, f"net {kinds['net']}, h int, n long")
    return told.groupBy("net", "h").agg(F.sum("n").alias("n"))


def _closest(points: DataFrame, planes: DataFrame) -> DataFrame:
    """(net, id, plane, off): each point's nearest plane, the first of equals; points of clouds without planes are left out.

    A cloud's planes, as many as ransac_planes() may find, go to its points as one list.
    """
    listed = planes.groupBy("net").agg(F.collect_list(F.struct("plane", *_PLANE)).alias("__planes"))
    p = angles.vector("p")
    off = lambda q: F.abs(sum(((x - q[f"a{c}"]) * q[f"u{c}"] for x, c in zip(p, "xyz")), F.lit(0.0)))
    near = F.array_min(F.transform("__planes", lambda q: F.struct(off(q).alias("off"), q["plane"].alias("plane"))))
    return points.join(listed, "net").select("net", "id", near.alias("b")).select("net", "id", F.col("b.plane").alias("plane"), F.col("b.off").alias("off"))


def ransac_planes(rows: DataFrame, tolerance: float | None = None, scale: float = 2.5, tries: int = 200, most: int = 20, wanted: int = 30, reach: float = 5.0, refits: int = 1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(net, id, plane) of every point and (net, plane, ax, ay, az, ux, uy, uz) of the planes found.

    rows has net, id, px, py, pz; id is unique in its net. One round looks for the next plane of every cloud at
    once: `tries` planes through three points left are proposed, the one that most points left lie within the
    tolerance of wins (the first of equals), is refitted to those points, and takes the points left that lie within
    the tolerance of it. A cloud is done when 50 points or fewer are left, when the best plane has fewer than least_inliers()
    points, or when `most` planes are found, a number to state, as every round compares the points left with all tries. The tolerance, if none is given, is
    `scale` times knn_scale() of the cloud. In the end points left over go to their nearest plane within `reach`
    tolerances, or to -1, and `refits` rounds fit every plane to its points and give each point its nearest one.
    Points with a null place take no part; an empty table and a cloud of fewer than three points have no planes.
    """
    places = rows.select("net", "id", "px", "py", "pz").dropna()
    size = places.groupBy("net").agg(F.count("*").alias("n"))
    clouds = size.withColumn("parts", F.ceil(F.col("n") / _PART).cast("int")).withColumn("need", least_inliers(F.col("n"), wanted))
    if tolerance is None:
        clouds = clouds.join(knn_scale(places).select("net", F.greatest(F.col("scale") * scale, F.lit(1e-9)).alias("tol")), "net", "left").fillna(1e-9, ["tol"])
    else:
        clouds = clouds.withColumn("tol", F.lit(float(tolerance)))
    clouds = written(clouds, "clouds")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # every point meets all tries, so even small clouds are dealt out
    points = written(places.join(clouds.select("net", "parts", "tol"), "net").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts").repartition(tasks, "id"), "cloud-points")
    left, found, held = points, None, None
    for i in range(most):
        sizes = written(left.groupBy("net").agg(F.count("*").alias("m")), "cloud-sizes")
        tried = written(_proposals(left, sizes, tries, seed + i), "proposals")
        counts = _inliers(left, tried, clouds)
        enough = sizes.join(clouds.select("net", "need"), "net").filter("m > greatest(50, need)")
        best = counts.groupBy("net").agg(F.max(F.struct("n", (-F.col("h")).alias("o"))).alias("b")).select("net", F.col("b.n").alias("n"), (-F.col("b.o")).alias("h"))
        won = written(best.join(enough, "net").filter("n >= need").join(tried, ["net", "h"]).select("net", *_PLANE), "won")
        if won.isEmpty():
            break
        inside = left.join(_spread(won, clouds), ["net", "part"]).filter(_off() < F.col("tol")).select("net", "px", "py", "pz")
        turned = _fitted(inside, ["net"]).select("net", "fx", "fy", "fz")
        normal = angles.aligned(angles.vector("f"), angles.vector("u"))
        plane = won.join(turned, "net", "left").select("net", F.lit(i).alias("plane"), "ax", "ay", "az", *(F.coalesce(x, F.col(f"u{c}")).alias(f"u{c}") for x, c in zip(normal, "xyz")))
        plane = written(plane, "plane")
        now = written(left.join(_spread(plane, clouds), ["net", "part"], "left").withColumn("plane", F.when(_off() < F.col("tol"), F.col("plane"))).select(*points.columns, "plane"), "cloud-left")
        took = now.filter("plane IS NOT NULL").select("net", "id", "plane")
        held, found = (took, plane) if held is None else (held.unionByName(took), found.unionByName(plane))
        going = won.select("net")
        left = now.filter("plane IS NULL").drop("plane").join(going, "net", "left_semi")
    if found is None:
        kinds = {f.name: f.dataType.simpleString() for f in points.schema}
        nothing = rows.sparkSession.createDataFrame([], f"net {kinds['net']}, plane int, " + ", ".join(f"{c} double" for c in _PLANE))
        return rows.select("net", "id", F.lit(-1).alias("plane")), nothing
    planes, labels = written(found, "planes"), written(held, "cloud-labels")
    tol = points.select("net", "id", "tol")
    bare = points.join(labels, ["net", "id"], "left_anti")
    near = _closest(bare, planes).join(tol, ["net", "id"]).filter(F.col("off") < reach * F.col("tol")).select("net", "id", "plane")
    labels = written(labels.unionByName(near), "cloud-labels")
    for _ in range(refits):
        fit = _fitted(points.join(labels, ["net", "id"]), ["net", "plane"]).withColumnsRenamed({f"a{c}": f"b{c}" for c in "xyz"})
        places_of = {f"a{c}": F.coalesce(f"b{c}", f"a{c}") for c in "xyz"} | {f"u{c}": F.coalesce(f"f{c}", f"u{c}") for c in "xyz"}
        planes = written(planes.join(fit, ["net", "plane"], "left").select("net", "plane", *(x.alias(c) for c, x in places_of.items())), "planes")
        labels = written(_closest(points, planes).join(tol, ["net", "id"]).filter(F.col("off") < reach * F.col("tol")).select("net", "id", "plane"), "cloud-labels")
    return rows.select("net", "id").join(labels, ["net", "id"], "left").withColumn("plane", F.coalesce("plane", F.lit(-1))), planes


def plane_directions(rows: DataFrame, labels: DataFrame, k: int = 64) -> DataFrame:
    """(net, id, qx, qy, qz): the normal of the plane through the points of a row's own segment; where it has none, of its k nearest points."""
    points = rows.select("net", "id", "px", "py", "pz").join(labels, ["net", "id"])
    fit = _fitted(points.filter("plane >= 0"), ["net", "plane"]).select("net", "plane", "fx", "fy", "fz")
    told = written(points.join(fit, ["net", "plane"], "left").select("net", "id", "fx", "fy", "fz"), "segment-normals")
    bare = told.filter("fx IS NULL").select("net", "id")
    local = local_planes(rows, k).join(bare, ["net", "id"], "left_semi").select("net", "id", *(F.col(f"e3{c}").alias(f"f{c}") for c in "xyz"))
    return told.filter("fx IS NOT NULL").unionByName(local).select("net", "id", *(F.col(f"f{c}").alias(f"q{c}") for c in "xyz"))


def segment_sizes(labels: DataFrame) -> DataFrame:
    """(net, plane, n, share): the points of every segment, -1 for those without one, and their share of the cloud."""
    n = labels.groupBy("net", "plane").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("net")))
