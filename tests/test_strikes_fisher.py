"""Sets of strikes alone, and concentrations of directed vectors."""

from __future__ import annotations

import numpy as np
import pytest

from strikeplane.operators import clusters, means


def test_strikes_half_a_turn_apart_are_one(spark):
    rng = np.random.default_rng(3)
    rows = [("two", i, float((40 if i % 2 else 130) + rng.normal(0, 4) + 180 * (i % 3 == 0))) for i in range(60)]
    rows += [("few", i, float(10 + i)) for i in range(5)] + [("few", 9, None)]
    got = {}
    for r in clusters.strike_sets(spark.createDataFrame(rows, "net string, id long, strike double").repartition(3), 2).collect():
        got.setdefault(r.net, []).append((r.n, r.strike, r.kappa, abs(r.mx * np.sin(np.radians(r.strike)) + r.my * np.cos(np.radians(r.strike)))))
    assert sorted(round(x[1] / 10) for x in got["two"]) == [4, 13] and {x[0] for x in got["two"]} == {30}
    assert [(x[0], pytest.approx(x[1])) for x in got["few"]] == [(5, 12.0)]
    assert all(x[2] == 0.1 and x[3] < 1e-9 for xs in got.values() for x in xs)


def test_fisher_concentrations(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g, kappa in enumerate((2.0, 15.0, 60.0)):
        c = 1 + np.log(rng.random(4000) * (1 - np.exp(-2 * kappa)) + np.exp(-2 * kappa)) / kappa
        a = rng.uniform(0, 2 * np.pi, 4000)
        s = np.sqrt(1 - c * c)
        rows += [(g, *map(float, v)) for v in zip(s * np.cos(a), s * np.sin(a), c)]
        want[g] = kappa
    rows += [(7, 1.0, 0.0, 0.0), (8, 0.0, 0.0, 1.0), (8, 0.0, 0.0, -1.0), (9, None, None, None)]
    got = {r.g: r for r in means.fisher_fit(spark.createDataFrame(rows, "g int, nx double, ny double, nz double"), ["g"]).collect()}
    for g, kappa in want.items():
        assert got[g].kappa == pytest.approx(kappa, rel=0.06) and got[g].mz > 0.99
        assert 1 / np.tanh(got[g].kappa * 1.000625) - 1 / (got[g].kappa * 1.000625) == pytest.approx(got[g].r, abs=1e-6)
    assert (got[7].kappa, got[7].mz, got[8].kappa) == (0.0, 1.0, 0.0) and 9 not in got


def test_many_nets_are_ordered_by_more_tasks(spark, monkeypatch):
    """A task ordered its share of all rows, however many there were; the rows drawn stay the same."""
    rows = spark.range(6000).selectExpr("id % 40 AS net", "id")
    want = sorted(map(tuple, clusters.few_by_hash(rows, 10).select("net", "id", "r").collect()))
    monkeypatch.setattr(clusters, "_ORDERED", 100)
    drawn = clusters.few_by_hash(rows, 10).select("net", "id", "r")
    assert "hashpartitioning(net" in (plan := drawn._jdf.queryExecution().executedPlan().toString()) and ", 16), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, drawn.collect())) == want and len(want) == 400
