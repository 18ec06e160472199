"""Planes in clouds, starts by k-means++, and sets that wells share, on planted data."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeplane.operators import clusters, planes

PLACE = "net string, id long, px double, py double, pz double"


def sheet(rng, net, first, n, normal, offset, noise=0.01):
    u = np.array(normal) / np.linalg.norm(normal)
    helper = np.array([1.0, 0, 0]) if abs(u[0]) < 0.9 else np.array([0, 1.0, 0])
    e = np.cross(u, helper)
    e /= np.linalg.norm(e)
    f = np.cross(u, e)
    return [(net, first + i, *(float(x) for x in rng.uniform(-5, 5) * e + rng.uniform(-5, 5) * f + (offset + rng.gauss(0, noise)) * u)) for i in range(n)]


def test_planted_planes_are_found(spark):
    rng = random.Random(1)
    normals = [(0, 0, 1), (1, 0, 0.2), (0.3, 1, 0)]
    rows = [p for i, n in enumerate(normals) for p in sheet(rng, "a", 400 * i, 400 - 60 * i, n, 6 * i)]
    rows += sheet(rng, "b", 0, 200, (1, 1, 1), 0) + [("few", 1, 0.0, 0.0, 0.0), ("few", 2, 1.0, 0.0, 0.0), ("a", 5000, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, PLACE)
    labels, found = planes.ransac_planes(df, tolerance=0.05, tries=60, most=5)
    got = {(r.net, r.id): r.plane for r in labels.collect()}
    assert len(got) == len(rows)
    assert got["a", 5000] == got["few", 1] == -1
    axes = {(r.net, r.plane): np.array([r.ux, r.uy, r.uz]) for r in found.collect()}
    for i, n in enumerate(normals):
        own = [got["a", 400 * i + j] for j in range(400 - 60 * i)]
        top = max(set(own), key=own.count)
        assert top >= 0 and own.count(top) > 0.9 * len(own)
        assert abs(axes["a", top] @ np.array(n)) / np.linalg.norm(n) > 0.999
    assert abs(axes["b", 0] @ np.ones(3)) / math.sqrt(3) > 0.999
    again, _ = planes.ransac_planes(df.repartition(7), tolerance=0.05, tries=60, most=5)
    assert {(r.net, r.id): r.plane for r in again.collect()} == got
    directions = {(r.net, r.id): (r.qx, r.qy, r.qz) for r in planes.plane_directions(df.dropna(), labels, 8).collect()}
    assert abs(np.array(directions["b", 7]) @ np.ones(3)) / math.sqrt(3) > 0.999


def test_clouds_without_planes(spark):
    empty = spark.createDataFrame([], PLACE)
    labels, found = planes.ransac_planes(empty, tolerance=0.1)
    assert labels.count() == found.count() == 0
    line = spark.createDataFrame([("l", i, float(i), 0.0, 0.0) for i in range(80)] + [("same", i, 1.0, 1.0, 1.0) for i in range(80)], PLACE)
    labels, found = planes.ransac_planes(line)
    assert found.count() == 0 and {r.plane for r in labels.collect()} == {-1}


@pytest.mark.parametrize("n,want", [(1500, 30), (1499, 149), (47, 4), (5, 3)])
def test_least_inliers(spark, n, want):
    assert spark.range(1).select(planes.least_inliers(F.lit(n), 30)).first()[0] == want


def families(rng, net, first, axes, each):
    out = []
    for j, axis in enumerate(axes):
        for i in range(each):
            x = np.array(axis) + [rng.gauss(0, 0.08) for _ in range(3)]
            x = x / np.linalg.norm(x) * rng.choice((-1, 1))
            out.append((net, first + j * each + i, *map(float, x), j, (i * 7) % 10 < 4))
    return out


AXES = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)]
NORMAL = "net string, id long, nx double, ny double, nz double, truth int, is_obs boolean"


def test_restarts_find_planted_sets(spark):
    rng = random.Random(2)
    df = spark.createDataFrame(families(rng, "a", 0, AXES, 200) + families(rng, "b", 0, AXES[:1], 2), NORMAL)
    placed = clusters.labelled(df, clusters.restarted(df, 4)).collect()
    own = {t: [r.set_id for r in placed if r.net == "a" and r.truth == t] for t in range(4)}
    tops = {t: max(set(s), key=s.count) for t, s in own.items()}
    assert len(set(tops.values())) == 4
    assert all(s.count(tops[t]) > 0.95 * len(s) for t, s in own.items())
    assert sum(r.net == "b" for r in placed) == 2


def test_wells_of_a_site_share_sets_and_hidden_rows_do_not_move_them(spark):
    rng = random.Random(3)
    df = spark.createDataFrame(families(rng, "w1", 0, AXES[:2], 100) + families(rng, "w2", 0, AXES[1:3], 100), NORMAL).withColumn("site", F.lit("s"))
    placed = clusters.joint_sets(df, 3)
    sets = {(r.net, r.truth): r.set_id for r in placed.groupBy("net", "truth").agg(F.mode("set_id").alias("set_id")).collect()}
    assert sets["w1", 1] == sets["w2", 0]  # both are the y axis
    assert len(set(sets.values())) == 3
    assert {r.net for r in clusters.joint_dispersion(placed).collect()} == {"w1", "w2"}
    changed = df.withColumns({c: F.when(F.col("is_obs"), F.col(c)).otherwise(F.lit(x)) for c, x in (("nx", 0.6), ("ny", 0.0), ("nz", 0.8))})
    of = lambda x: {(r.net, r.id): r.set_id for r in clusters.observed_sets(x, 2, tries=4).filter("is_obs").collect()}
    assert of(df) == of(changed)


def test_tries_are_drawn_from_the_points_of_least_hash(spark, monkeypatch):
    """All points left were sorted three times a round; those that can't be drawn are left out, and the tries stay the same."""
    rng = random.Random(4)
    df = spark.createDataFrame(sheet(rng, "a", 0, 4000, (1, 2, 3), 1) + sheet(rng, "b", 0, 50, (0, 0, 1), 0), PLACE)
    sizes = df.groupBy("net").agg(F.count("*").alias("m"))
    drawn = planes._proposals(df, sizes, 3, 7)
    got = sorted(map(tuple, drawn.collect()))
    monkeypatch.setattr(planes, "_DRAWN", 1e9)
    assert got == sorted(map(tuple, planes._proposals(df, sizes, 3, 7).collect()))
    assert [r[1] for r in got if r[0] == "a"] == [0, 1, 2]  # a try of few points may draw one twice
