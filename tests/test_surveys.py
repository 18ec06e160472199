"""Estimated sets, surveys and evidence against planted data, with their empty, tie and null cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strikeplane.operators import evidence, predict, surveys

ROW = "net int, id long, px double, py double, pz double, nx double, ny double, nz double, is_obs boolean"
AXES = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]


def near(axis, rng, spread=0.05):
    v = [a + rng.gauss(0, spread) for a in axis]
    s = math.sqrt(sum(x * x for x in v)) * rng.choice((1, -1))
    return [x / s for x in v]


def planted(n, net=1, seed=3):
    rng = random.Random(seed)
    return [(net, i, float(i % 3) * 10 + rng.random(), rng.random() * 5, rng.random(), *near(AXES[i % 3], rng), rng.random() < 0.5) for i in range(n)]


def test_estimated_sets_find_planted_axes(spark):
    rows = spark.createDataFrame(planted(240), ROW)
    table, placed = surveys.estimated_sets(rows, AXES)
    for t in table.collect():
        assert abs(t[f"m{'xyz'[t.set_id]}"]) > 0.999 and t.n_points == 80
    assert all(p.set_id == p.id % 3 and p.angle < 25 for p in placed.collect())
    spread = surveys.set_spread(placed).collect()
    assert all(s.n == 80 and s.statistical and 0 < s.dispersion < s.max_deviation for s in spread)


def test_hidden_normals_do_not_move_the_sets(spark):
    rows = spark.createDataFrame(planted(240), ROW)
    table, _ = surveys.estimated_sets(rows, AXES)
    again, _ = surveys.estimated_sets(predict.poisoned(rows, 5), AXES)
    key = lambda t: {r.set_id: (r.mx, r.my, r.mz) for r in t.collect()}
    assert key(table) == key(again)
    leaky, _ = surveys.estimated_sets(rows, AXES, observed_only=False)
    assert key(leaky) != key(table)


def test_nets_of_one_observed_row_and_of_none(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, True), (1, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, False), (2, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, False)]
    table, placed = surveys.estimated_sets(spark.createDataFrame(rows, ROW), AXES)
    assert [(t.net, t.set_id, t.n_points, t.mz) for t in table.collect()] == [(1, 0, 1, 1.0)]
    assert {(p.net, p.id): p.set_id for p in placed.collect()} == {(1, 0): 0, (1, 1): -1, (2, 0): -1}
    empty, none = surveys.estimated_sets(spark.createDataFrame([], ROW), AXES)
    assert empty.count() == none.count() == 0


def test_scores_of_equal_tables_and_of_one_that_is_missing(spark):
    schema = "net int, set_id int, mx double, my double, mz double"
    truth = [(1, k, *AXES[k]) for k in range(3)] + [(2, 0, *AXES[0])]
    turned = [(1, (k + 1) % 3, *(-x for x in AXES[k])) for k in range(3)]
    got = {s.net: s for s in surveys.table_scores(spark.createDataFrame(turned, schema), spark.createDataFrame(truth, schema)).collect()}
    assert (got[1].modal_error, got[1].coverage, got[1].k_diff, got[1].n_matched, got[1].ari) == (0.0, 1.0, 0, 3, None)
    assert (got[2].modal_error, got[2].coverage, got[2].k_diff, got[2].n_matched) == (90.0, 0.0, 1, 0)


def test_surveys_choose_the_planted_number(spark):
    rows = spark.createDataFrame(planted(150), ROW)
    full = surveys.full_survey(rows, most=4).collect()
    block = surveys.block_survey(rows, most=4).collect()
    assert [f.k for f in full] == [3] and full[0].mae < 6 and full[0].n == sum(not r[-1] for r in planted(150))
    assert len(block) == 1 and block[0].n == 90
    small = surveys.chosen_centers(spark.createDataFrame(planted(2, net=9), ROW), most=3).collect()
    assert [(c.net, c.k, len(c.centers)) for c in small] == [(9, 1, 1)]


def test_set_directions_borrow_and_refuse(spark):
    schema = "net int, id long, set_id int, nx double, ny double, nz double, is_obs boolean"
    rows = [(1, 0, 0, 0.0, 0.0, 2.0, True), (1, 1, 0, 0.0, 0.0, -1.0, True), (1, 2, 1, 1.0, 0.0, 0.0, False), (1, 3, None, 1.0, 0.0, 0.0, True), (2, 0, 3, 1.0, 0.0, 0.0, False), (2, 1, 3, 0.0, 0.0, 0.0, True)]
    got = {(r.net, r.set_id): r for r in surveys.set_directions(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1, 0].mz, got[1, 0].n_obs, got[1, 0].borrowed) == (1.0, 2, False)
    assert (got[1, 1].mz, got[1, 1].n_obs, got[1, 1].borrowed) == (1.0, 0, True)
    assert (got[2, 3].mz, got[2, 3].borrowed) == (1.0, True) and len(got) == 3
    with pytest.raises(Exception, match="not below 3"):
        surveys.set_directions(spark.createDataFrame(rows, schema), most=3).collect()


def test_semantic_blends_or_not_and_averages_few(spark):
    rows = planted(120) + [(7, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, True), (7, 1, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0, True), (7, 2, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, False), (8, 0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, False)]
    told = predict.blind(spark.createDataFrame(rows, ROW))
    plain = {(r.net, r.id): r for r in predict.semantic(told, AXES, k=3, blend=0.0).collect()}
    nearest = {(r.net, r.id): r for r in predict.nearest_direction(told).filter("net = 1").collect()}
    assert all(abs(plain[k].qx * n.qx + plain[k].qy * n.qy + plain[k].qz * n.qz) > 1 - 1e-9 for k, n in nearest.items())
    few = {(r.net, r.id): r for r in predict.semantic(told, AXES, k=6).collect()}
    assert abs(few[7, 2].qz) > 1 - 1e-9 and (8, 0) not in few
    assert len(few) == 1 + sum(not r[-1] for r in planted(120))


def test_net_checks_name_the_fault(spark):
    schema = "net int, id long, nx double, ny double, nz double"
    rows = [(1, 4, None, 0.0, 1.0), (1, 2, float("nan"), 0.0, 1.0), (1, 3, 0.0, 0.0, 0.0), (1, 1, 0.0, 0.0, 1.0), (2, 1, 0.0, 0.0, 1.0), (None, 1, 0.0, float("inf"), 1.0)]
    got = {r.net: r[1:] for r in surveys.net_checks(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (4, 1, 1, 1, 2, False), 2: (1, 0, 0, 0, None, True), None: (1, 0, 1, 0, 1, False)}
    with pytest.raises(ValueError, match="nz"):
        surveys.net_checks(spark.createDataFrame([(1, 1, 0.0, 0.0)], "net int, id long, nx double, ny double"))


def test_bundle_keeps_constraints_apart(spark):
    logs = spark.createDataFrame([("a", "joint", 0.0, 0.0, 3.0), ("a", "vein", 0.0, 2.0, 0.0), ("a", None, 0.0, 0.0, 1.0), (None, "fault", 1.0, 0.0, 0.0), ("b", "joint", None, 0.0, 1.0), ("b", "joint", 0.0, 0.0, 0.0)], "well string, kind string, nx double, ny double, nz double")
    traces = spark.createDataFrame([("w", 190.0), ("w", -10.0), ("w", None)], "w string, s double")
    told = evidence.bundle(evidence.typed_normals(logs, "L1", F.col("well"), F.col("kind")), evidence.strikes(traces, F.col("w"), F.col("s")))
    got = {(e.source_name, e.structure_type): (e.n_obs, e.constraint_only) for e in evidence.entries(told).collect()}
    assert got == {("a_joint", "joint"): (1, False), ("a_vein", "unknown"): (1, False), ("a", "unknown"): (1, False), (None, "fault"): (1, False), ("w", "unknown"): (2, True)}
    seen = evidence.observed_normals(told).collect()
    assert len(seen) == 4 and all(abs(r.nx**2 + r.ny**2 + r.nz**2 - 1) < 1e-12 for r in seen)
    assert sorted(r.strike for r in told.filter("source_type = 'L2'").collect()) == [10.0, 170.0]


def test_tables_are_resolved_by_place_or_alone(spark):
    tables = spark.createDataFrame([("L0", 0), ("L0", 1), ("L3", 2)], "source_type string, idx long")
    wanted = spark.createDataFrame([("L0", 1), ("L3", None), ("L3", 0), ("L2", 0)], "source_type string, idx long")
    got = {(r.source_type, r.idx): r.table for r in evidence.resolved(wanted, tables).collect()}
    assert got == {("L0", 1): 1, ("L3", None): 2, ("L3", 0): 2, ("L2", 0): None}
    with pytest.raises(Exception, match="2 tables are of type L0"):
        evidence.resolved(spark.createDataFrame([("L0", 2)], "source_type string, idx long"), tables).collect()


def test_consistency_counts(spark):
    rows = [(0, 0, 3.0, "green", "fused"), (1, 1, 25.0, "yellow", "excluded"), (2, 2, 50.0, "red", "excluded"), (3, None, None, "yellow", "single")]
    schema = "set_a int, set_b int, angle double, light string, outcome string"
    assert tuple(evidence.consistency_counts(spark.createDataFrame(rows, schema)).first()) == (1, 2, 1, 1, 2, 1)
    assert tuple(evidence.consistency_counts(spark.createDataFrame([], schema)).first()) == (0, 0, 0, 0, 0, 0)


def test_segments_of_rows_with_one_id(spark, tmp_path):
    """Of rows that share the least id the first in the table turns the segment, wherever its parts were read."""
    from strikeplane.plans import registry, surveyed

    rows = [(0, 0, i, 1, 1.0 * (i % 50), "A") for i in range(40)]
    rows += [(0, 1, 7, 1, float(q), "B") for q in (3, 40, 21, 12, 33)] + [(1, 1, 8, 1, float(q), "B") for q in range(30)]
    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in c.execute(registry.ORACLE_SQL["segment_entries"]).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in surveyed.segment_entries(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-4) for k in want)
    tied = [(0, 5, 1, 0.6, 0.0, 0.8), (0, 5, 1, -0.8, 0.0, -0.6), (0, 6, 1, 0.0, 1.0, 0.0)]
    frame = lambda r: spark.createDataFrame(r, "net int, id long, seg_id int, nx double, ny double, nz double").coalesce(1)
    told = lambda r: [(x.nx, x.ny, x.nz) for x in evidence.segments(frame(r)).collect()]
    assert told(tied) == told(tied[::-1])
