"""The percolation curve: discs dealt to sets by their shares, thresholds of the curve, axes and periodic walls."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeplane.operators import networks
from strikeplane.plans import registry

SETS = "set_id int, proportion double, mx double, my double, mz double, kappa double"


def wanted(x, y, target):
    """The method's own rule, step by step."""
    if max(y) < target:
        return x[-1]
    if min(y) > target:
        return x[0]
    for i in range(len(y) - 1):
        if y[i] <= target <= y[i + 1]:
            return x[i] + (target - y[i]) / (y[i + 1] - y[i] + 1e-12) * (x[i + 1] - x[i])
    return x[len(y) // 2]


def test_thresholds_of_curves(spark):
    curves = [[0.0, 0.2, 0.6, 1.0], [0.0, 0.0, 0.1, 0.2], [0.6, 0.7, 0.9, 1.0], [0.9, 0.4, 0.3, 0.2], [0.9, 0.1, 0.9, 1.0], [0.5, 0.5, 0.5, 0.5], [0.0, 0.5, 0.5, 1.0], [0.3], [0.5]]
    x = [0.1, 0.2, 0.4, 0.8]
    rows = [(i, [(a, b) for a, b in zip(x, y)]) for i, y in enumerate(curves)]
    df = spark.createDataFrame(rows, "i int, curve array<struct<x: double, y: double>>")
    got = {r.i: r for r in df.select("i", *(networks.threshold(F.col("curve"), t).alias(c) for c, t in networks.CRITICAL.items())).collect()}
    for i, y in enumerate(curves):
        assert [got[i][c] for c in networks.CRITICAL] == pytest.approx([wanted(x[: len(y)], y, t) for t in networks.CRITICAL.values()])


def test_every_set_has_its_share_of_discs(spark):
    for shares in ([0.5, 0.3, 0.2], [1 / 3, 1 / 3, 1 / 3], [0.125, 0.125, 0.75], [0.5, 0.5]):
        df = spark.range(0, 60).select(F.col("id").alias("n")).withColumn("c", networks.dealt(F.col("n"), shares, lambda j: networks.uniform(F.col("n"), j)))
        for r in df.collect():
            counts = np.round(np.array(shares) * r.n).astype(int)
            assert sum(r.c) == r.n
            while counts.sum() > r.n:
                counts[np.argmax(counts)] -= 1
            extra = np.array(r.c) - counts
            assert (extra >= 0).all() and extra.sum() == r.n - counts.sum()
    sets = spark.createDataFrame([(0, 0.7, 0.0, 0.0, 1.0, 10.0), (1, 0.3, 1.0, 0.0, 0.0, 10.0)], SETS)
    runs = spark.createDataFrame([(0, 0.2, 0), (1, 0.001, 0), (2, 0.0, 0)], "net long, p32 double, seed int")
    discs = networks.generate(spark, sets, runs, (10.0, 10.0, 10.0), least_n=30).groupBy("net").agg(F.count("*").alias("n"), F.count(F.when(F.col("set_id") == 0, 1)).alias("first"))
    told = {r.net: (r.n, r.first) for r in discs.collect()}
    assert told[1] == (30, 21) and told[0][1] == round(told[0][0] * 0.7) and 2 not in told


def test_the_curve_has_its_critical_intensities(spark):
    sets = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 1.0, 1.0)], SETS)
    grid = [0.05, 0.4, 1.0]
    for axis, periodic in ((0, False), (2, True)):
        rows = sorted(networks.percolation(spark, sets, grid, 4, (8.0, 8.0, 8.0), axis=axis, periodic=periodic, least_n=5).collect())
        assert [r.p32 for r in rows] == grid and rows[-1].p_conn == 1.0
        for c, t in networks.CRITICAL.items():
            assert [r[c] for r in rows] == pytest.approx([wanted(grid, [r.p_conn for r in rows], t)] * 3)


def test_the_query_draws_twenty_networks_for_each_intensity(spark, sf_dir, monkeypatch):
    asked = []
    monkeypatch.setattr(networks, "percolation", lambda *a, **k: asked.append(a) or spark.range(1))
    registry.QUERIES["percolation"](spark, sf_dir)
    assert asked[0][3] == 20
