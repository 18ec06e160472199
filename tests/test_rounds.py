"""Rounds of k-means and scores of many models: nets that are one task's as a whole and larger ones, against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeplane.operators import clusters, rounds


def plain(x, c, n):
    for _ in range(n):
        d = x @ c.T
        k = np.abs(d).argmax(axis=1)
        s = np.stack([(x * np.sign(d[np.arange(len(x)), k])[:, None])[k == i].sum(axis=0) for i in range(len(c))])
        size = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(size > 1e-12, s / np.maximum(size, 1e-12), c)
    return c


def data(spark, name):
    rng = np.random.default_rng(3)
    nets = {}
    for net, n in enumerate((400, 90, 5)):
        dip, direction = np.radians(rng.integers(0, 91, n)), np.radians(rng.integers(0, 6, n) * 60)
        nets[net] = np.stack([np.sin(dip) * np.sin(direction), np.sin(dip) * np.cos(direction), np.cos(dip)], axis=1)
    rows = [(name(net), i, *map(float, v)) for net, x in nets.items() for i, v in enumerate(x)] + [(name(0), 999, None, 0.0, 1.0), (None, 1, 0.0, 0.0, 1.0)]
    kind = {int: "int", str: "string", tuple: "struct<a: int, b: string>"}[type(name(0))]
    return nets, spark.createDataFrame(rows, f"net {kind}, id long, nx double, ny double, nz double").repartition(5)


@pytest.mark.parametrize("whole", [1 << 16, 60])
@pytest.mark.parametrize("name", [int, str, lambda n: (n, f"s{n}")], ids=["int", "string", "struct"])
def test_small_and_large_nets_go_the_same_way(spark, monkeypatch, whole, name):
    monkeypatch.setattr(rounds, "_WHOLE", whole)
    nets, df = data(spark, name)
    starts = {k: c for k, c in clusters.nested_starts(df.filter("nx is not null and net is not null"), (2, 3, 5)).items()}
    found = clusters.lloyd_grid(df, starts, 4)
    told = {(r.net, r.k): r for r in clusters.grid_scores(df, found).collect()}
    assert len(told) == 9
    for k in starts:
        first, last = ({r.net: np.array([tuple(c) for c in r.centers]) for r in t.collect()} for t in (starts[k], found[k]))
        for net, x in nets.items():
            assert last[name(net)] == pytest.approx(plain(x, first[name(net)], 4), abs=1e-9)
    rows = df.filter("nx is not null and net is not null")
    for k, c in found.items():
        placed = clusters.labelled(rows, c)
        both = clusters.silhouette(placed, ["net"]).join(clusters.mixture_bic(placed, ["net"], F.lit(k)).select("net", "bic"), "net")
        for r in both.collect():
            assert (told[r.net, k].n, told[r.net, k].silhouette, told[r.net, k].bic) == pytest.approx((r.n, r.silhouette, r.bic), abs=1e-9)


def test_equal_normals_are_one_row_for_every_k(spark, monkeypatch):
    """choose_k() of rows that repeat: the scores are those of all rows, and what is clustered are distinct normals."""
    nets, df = data(spark, int)
    df = df.filter("nx is not null and net is not null")
    three = df.withColumn("id", F.explode(F.array(F.col("id"), F.col("id") + 10000, F.col("id") + 20000)))
    seen, grid = [], clusters.lloyd_grid
    monkeypatch.setattr(clusters, "lloyd_grid", lambda rows, *a: seen.append(rows.count()) or grid(rows, *a))
    got = {(r.net, r.k): r for r in clusters.choose_k(three, 2, 4, 3).collect()}
    assert seen == [df.select("net", "nx", "ny", "nz").distinct().count()] and len(got) == 9
    found = grid(three, clusters.nested_starts(three, (2, 3, 4)), 3)
    for r in clusters.grid_scores(three, found).collect():
        assert (got[r.net, r.k].n, got[r.net, r.k].silhouette, got[r.net, r.k].bic) == pytest.approx((r.n, r.silhouette, r.bic), abs=1e-9)


def test_a_grid_of_many_k_is_planned_at_once(spark):
    """Twelve rounds of two to twelve sets, whose wide plans once ended the driver, in a few jobs."""
    _, df = data(spark, str)
    tracker, group = spark.sparkContext.statusTracker(), "rounds-of-many-k"
    spark.sparkContext.setJobGroup(group, "")
    clusters.choose_k(df.filter("nx is not null and net is not null"), 2, 12, 12).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) < 40


def test_starts_are_found_over_rows_alone(spark):
    """The farthest-first rows of each net, by plain numpy, also of nets smaller than k; no list of rows is made in the plan."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(0 if i < 280 else i // 7, i, *map(float, v)) for i, v in enumerate(x)] + [(0, 500, None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "net int, id long, nx double, ny double, nz double").repartition(4)
    found = clusters.starting_centers(df, 4, pool=64)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    drawn = {}
    for r in clusters.few_by_hash(df.filter("nx is not null"), 64).orderBy("net", "r").collect():
        drawn.setdefault(r.net, []).append((r.nx, r.ny, r.nz))
    got = {r.net: np.array([tuple(c) for c in r.centers]) for r in found.collect()}
    assert got.keys() == drawn.keys() and len(got) == 4
    for net, pool in drawn.items():
        p, at = np.array(pool), [0]
        while len(at) < min(4, len(p)):
            at.append(int(np.abs(p @ p[at].T).max(axis=1).argmin()))
        assert got[net] == pytest.approx(p[at])
