"""A round of EM makes no row for a row and a set; nets with fewer sets and rows without a normal do no harm."""

from __future__ import annotations

from strikeplane.operators import clusters


def test_rounds_sum_flat_rows(spark, monkeypatch):
    rows = [(0, i, 0.6, 0.1 * (i % 3), 0.8) for i in range(9)] + [(0, 9 + i, 0.0, 1.0, 0.1 * (i % 2)) for i in range(6)] + [(1, 50, 1.0, 0.0, 0.0), (0, 60, None, None, None)]
    df = spark.createDataFrame(rows, "net int, id long, nx double, ny double, nz double")
    plans, keep = [], clusters.written

    def seen(d, name):
        plans.extend([d._jdf.queryExecution().optimizedPlan().toString()] if name == "em-sums" else [])
        return keep(d, name)

    start = spark.createDataFrame([(0, [(0.6, 0.1, 0.79), (0.0, 1.0, 0.0)]), (1, [(1.0, 0.0, 0.0)])], "net int, centers array<struct<x: double, y: double, z: double>>")
    monkeypatch.setattr(clusters, "written", seen)
    got = {(r.net, r.k): r for r in clusters.em_mixture(df, start, 1).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0)}
    assert abs(got[1, 0].share - 1) < 1e-9 and abs(got[0, 0].share + got[0, 1].share - 1) < 1e-9
    assert plans and all("posexplode" not in p for p in plans)
