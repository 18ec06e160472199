"""Predictors that share one search for nearest rows, and a search that keeps its pairs inside tasks."""

from __future__ import annotations

import numpy as np

from strikeplane.operators import neighbours, predict

ROW = "net int, id long, px double, py double, pz double, nx double, ny double, nz double, is_obs boolean"
CENTERS = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]


def points(spark, n=120):
    rng = np.random.default_rng(4)
    p, v = rng.random((n, 3)), rng.normal(size=(n, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i % 2, i, *map(float, p[i]), *map(float, v[i]), i % 5 < 2) for i in range(n)], ROW)


def test_given_nearest_rows_serve_every_predictor(spark, monkeypatch):
    rows = predict.blind(points(spark))
    key = lambda df: {(r.net, r.id): (round(r.qx, 9), round(r.qy, 9), round(r.qz, 9)) for r in df.collect()}
    made = lambda found: [key(predict.majority(rows, CENTERS, 5, found=found)), key(predict.top_two(rows, CENTERS, 9, found=found)), key(predict.set_aware_observed(rows, CENTERS, found))]
    alone, found = made(None), predict.looked_up(rows, 9)
    monkeypatch.setattr(neighbours, "nearest", None)  # a second search would fail
    assert made(found) == alone


def test_pairs_of_a_search_stay_in_tasks(spark, monkeypatch):
    plans, keep = {}, neighbours.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(neighbours, "written", seen)
    monkeypatch.setattr(neighbours, "_ASKED", 7)  # full cells are dealt to several tasks
    rows = points(spark)
    got = neighbours.nearest(rows, rows, 3)
    assert "CoGroup" in plans["near-ranked"]
    assert got.count() == 3 * rows.count()


def test_directions_that_rest_are_left_alone():
    rng = np.random.default_rng(3)
    n = rng.normal(size=(40, 3)) * [1, 0.2, 0.2]
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    w = rng.random((7, 40)) + 0.1
    start = np.array([1.0, 0.0, 0.0])
    v = np.tile(start, (7, 1))
    for _ in range(40):
        c = v @ n.T
        new = (w * np.where(c < 0, -1.0, 1.0) / np.sqrt(np.maximum(1 - c * c, 1e-6))) @ n
        v = new / np.linalg.norm(new, axis=1, keepdims=True)
    assert np.allclose(predict.projective_median(n, w, start), v, atol=1e-9)
