"""Geometry, clusters, networks, fusion and readers on small tables with known answers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeplane.functions import angles, grades
from strikeplane.operators import aggregates, clusters, fusion, neighbours, networks, ordered, predict, quality, screening
from strikeplane.sources import logs, sinks
from strikeplane.streaming import logs as streams


def unit(dip, direction):
    d, a = math.radians(dip), math.radians(direction)
    return math.sin(d) * math.sin(a), math.sin(d) * math.cos(a), math.cos(d)


def family(rng, dip, direction, n, spread=5.0):
    return [unit(min(90, max(0, rng.gauss(dip, spread))), rng.gauss(direction, spread) % 360) for _ in range(n)]


def test_known_planes(spark):
    rows = spark.createDataFrame([(0.0, 123.0), (90.0, 90.0), (45.0, 180.0), (30.0, 359.0)], "dip double, dip_dir double")
    got = logs.with_normals(rows).collect()
    assert (got[0].nx, got[0].ny, got[0].nz) == pytest.approx((0, 0, 1))
    assert (got[1].nx, got[1].ny, got[1].nz) == pytest.approx((1, 0, 0), abs=1e-12)
    assert (got[2].nx, got[2].ny, got[2].nz) == pytest.approx((0, -math.sqrt(0.5), math.sqrt(0.5)), abs=1e-12)
    n = angles.vector()
    for turn in (1, -1):
        both = logs.with_normals(rows).withColumns({c: F.col(c) * turn for c in ("nx", "ny", "nz")}).select("dip", "dip_dir", angles.dip(n).alias("d"), angles.dip_direction(n).alias("a")).collect()
        for r in both[1:] if turn == 1 else both[2:]:
            assert r.d == pytest.approx(r.dip, abs=1e-5) and r.a == pytest.approx(r.dip_dir, abs=1e-5)


def test_random_planes_are_57_degrees_apart(spark):
    u = lambda i: networks.uniform(F.col("id"), F.lit(i))
    v = lambda i: networks.fisher_direction(u(i), u(i + 50), F.lit(0.0), angles.literal((0, 0, 1)))
    mean = spark.range(50000).select(F.avg(angles.angle(v(1), v(2)))).first()[0]
    assert mean == pytest.approx(57.2958, abs=0.5)


@pytest.mark.parametrize("angle,light", [(19.999, "green"), (20.0, "yellow"), (34.999, "yellow"), (35.0, "red")])
def test_gates(spark, angle, light):
    assert spark.range(1).select(grades.traffic_light(F.lit(angle))).first()[0] == light


def test_dirty_log(spark):
    rows = [("w", i, float(i), 40.0, 100.0 + i) for i in range(25)] + [("w", 30, 5.0, 95.0, 1.0), ("w", 31, 5.0, -3.0, 1.0), ("w", 32, 5.0, 3.0, 400.0), ("w", 33, 1.0, 40.0, 101.0), ("w", 34, 2.0, 40.0, 102.0), (None, 1, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "well string, row_id long, depth double, dip double, dip_dir double")
    r = {x.well: x for x in quality.quality_report(quality.flagged(df)).collect()}
    assert (r["w"].n_out_of_range, r["w"].n_duplicate, r["w"].n_ok, r["w"].grade, r["w"].monotone) == (3, 2, 25, "B", True)
    assert (r["unnamed"].n_null, r["unnamed"].grade) == (1, "F")
    assert quality.clean(df).count() == 25


def test_checked_normals(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, 0.0)], "nx double, ny double, nz double")
    with pytest.raises(Exception, match="a normal is missing"):
        quality.checked_normals(df, "test").collect()


def test_three_families_are_found(spark):
    rng = random.Random(42)
    truth = [(60, 30), (45, 150), (70, 280)]
    rows = [("net", i * 3 + k, *v) for k, (d, a) in enumerate(truth) for i, v in enumerate(family(rng, d, a, 20))]
    df = spark.createDataFrame(rows, "net string, id long, nx double, ny double, nz double")
    centers = clusters.lloyd(df, clusters.starting_centers(df, 3), 10)
    placed = clusters.labelled(df, centers)
    assert sorted(r["count"] for r in placed.groupBy("set_id").count().collect()) == [20, 20, 20]
    found = [(c.x, c.y, c.z) for c in centers.first().centers]
    for d, a in truth:
        assert max(abs(np.dot(unit(d, a), c)) for c in found) > math.cos(math.radians(6))
    best = clusters.choose_k(df, 2, 5, 8).filter("chosen").first()
    assert best.k == 3


def test_one_row_nets_and_more_sets_than_rows(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0, 1.0), ("b", 1, 1.0, 0.0, 0.0), ("b", 2, 0.0, 1.0, 0.0)], "net string, id long, nx double, ny double, nz double")
    centers = clusters.lloyd(df, clusters.starting_centers(df, 4), 3)
    assert {r.net: len(r.centers) for r in centers.collect()} == {"a": 1, "b": 2}


def test_assignment_is_best():
    rng = np.random.default_rng(0)
    from itertools import permutations

    for n, m in ((3, 3), (2, 5), (5, 3), (1, 1), (7, 7), (4, 8), (6, 2)):
        cost = rng.random((n, m))
        pairs = fusion.assignment(cost)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) == min(n, m)
        got = sum(cost[i, j] for i, j in pairs)
        small = cost if n <= m else cost.T
        assert got == pytest.approx(min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small))))


def test_pools_of_three_wells(spark):
    """Two wells of the same sets pool; a third of other sets does not."""
    rng = random.Random(1)
    rows = [(w, k * 100 + i, *v) for w in (0, 1) for k, (d, a) in enumerate([(10, 90), (60, 45)]) for i, v in enumerate(family(rng, d, a, 60, 3))]
    rows += [(2, k * 100 + i, *v) for k, (d, a) in enumerate([(35, 200), (70, 300)]) for i, v in enumerate(family(rng, d, a, 60, 3))]
    df = spark.createDataFrame(rows, "net int, id long, nx double, ny double, nz double")
    centers = clusters.lloyd(df, clusters.starting_centers(df, 2), 10)
    tables = centers.select(F.col("net").alias("table"), F.posexplode("centers").alias("set_id", "c")).select("table", "set_id", *(F.col(f"c.{c}").alias(f"m{c}") for c in "xyz"))
    pairs = fusion.consistency(fusion.matches(fusion.table_pairs(tables, "table")))
    pools = {r.table: (r.pool, r.tier) for r in fusion.joint_pools(pairs, tables).collect()}
    assert pools[0][0] == pools[1][0] == 0 and pools[2][0] == 2
    assert pools[0][1] == "joint" and pools[2][1] != "joint"
    alone = fusion.joint_pools(pairs.limit(0), tables.filter("table = 0")).first()
    assert (alone.best_angle, alone.tier, alone.pool) == (999.0, "independent", 0)


def test_conflicting_sources(spark):
    table = spark.createDataFrame([("a", 0, 30, 20.0, *unit(10, 0)), ("b", 0, 30, 30.0, *unit(70, 120)), ("b", 1, 9, 5.0, *unit(12, 2))], "src string, set_id int, n int, kappa double, mx double, my double, mz double")
    got = {(r.set_a, r.set_b): (r.light, r.outcome) for r in fusion.reconcile(table, "src", "a", "b").collect()}
    assert got == {(0, 1): ("green", "fused"), (None, 0): ("yellow", "single")}
    fused = {(r.set_a, r.set_b): (r.n, r.kappa) for r in fusion.fused_centers(table, "src", "a", "b").collect()}
    assert fused == {(0, 1): (39, 20.0), (None, 0): (30, 30.0)}


def points(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    p = rng.random((n, 3)) * [4, 2, 1]
    v = rng.normal(size=(n, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i % 2, i, *map(float, p[i]), *map(float, v[i]), bool(i % 5 < 2), i % 4, i // 6) for i in range(n)]
    return spark.createDataFrame(rows, "net int, id long, px double, py double, pz double, nx double, ny double, nz double, is_obs boolean, set_id int, fracture_id long"), p, v


@pytest.mark.parametrize("k", [1, 7, 200])
def test_nearest_is_exact(spark, k):
    df, p, _ = points(spark)
    got = {(r.id, r["rank"]): r.other for r in neighbours.nearest(df, df, k).collect()}
    for i in range(0, 240, 17):
        same = [j for j in range(240) if j % 2 == i % 2 and j != i]
        order = sorted(same, key=lambda j: (round(float(((p[i] - p[j]) ** 2).sum()), 12), j))[:k]
        assert [got[i, r + 1] for r in range(len(order))] == order


def test_predictors_do_not_read_hidden_normals(spark):
    df, _, _ = points(spark)
    for f in (predict.nearest_direction, predict.set_aware, predict.fracture_aware, predict.local_median, predict.global_direction, lambda x: predict.majority(x, [unit(60, 30), unit(45, 150)], 5)):
        named = lambda x, f=f: f(x).withColumnsRenamed({f"q{c}": f"p{c}" for c in "xyz"}).drop("d2")
        changed = quality.leaks(named(predict.blind(df)), named(predict.poisoned(df, 1)))
        assert [r.n_changed for r in changed.collect()] == [0, 0]


def test_plane_of_a_fracture(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f in range(6):
        n = np.array(unit(20 + 10 * f, 50 * f))
        e1 = np.cross(n, [0, 0, 1.0]) if abs(n[2]) < 0.9 else np.cross(n, [1.0, 0, 0])
        e1 /= np.linalg.norm(e1)
        for i in range(20):
            a, b = rng.normal(size=2)
            x = a * e1 + b * np.cross(n, e1)
            rows.append((0, f * 100 + i, *map(float, x), *map(float, n), i < 8, f, f))
    df = spark.createDataFrame(rows, "net int, id long, px double, py double, pz double, nx double, ny double, nz double, is_obs boolean, set_id int, fracture_id long")
    worst = predict.errors(predict.fracture_aware(predict.blind(df)), df).agg(F.max("error")).first()[0]
    assert worst < 1e-3


def test_local_median_is_robust(spark):
    rng = random.Random(2)
    v = family(rng, 50, 100, 30, 2) + family(rng, 5, 5, 8, 2)
    rows = [(0, i, rng.random(), rng.random(), rng.random(), *x, True) for i, x in enumerate(v)] + [(0, 1000, 0.5, 0.5, 0.5, *unit(50, 100), False)]
    df = spark.createDataFrame(rows, "net int, id long, px double, py double, pz double, nx double, ny double, nz double, is_obs boolean")
    assert predict.errors(predict.local_median(predict.blind(df)), df).first().error < 5


def test_periodic_edges(spark):
    rows = [(0, i, 0.2 + i, 5.0, 5.0, 0.45) for i in range(10)]
    df = spark.createDataFrame(rows, "net int, id long, px double, py double, pz double, radius double")
    assert neighbours.disc_edges(df, 0.5).count() == 0
    wide = df.withColumn("radius", F.lit(0.6))
    assert neighbours.disc_edges(wide, 0.6).count() == 9
    assert neighbours.disc_edges(wide, 0.6, (10.0, 10.0, 10.0)).count() == 10


def test_components_and_spanning(spark):
    discs = spark.createDataFrame([(0, i, float(i * 10), 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(11)] + [(1, 0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "net int, id long, px double, py double, pz double, nx double, ny double, nz double")
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(10)], "net int, a long, b long")
    labels = networks.components(discs, edges)
    got = {r.net: (r.n_components, r.largest, r.spans) for r in networks.connectivity(discs, labels, (100.0, 1.0, 1.0)).collect()}
    assert got == {0: (1, 11, True), 1: (1, 1, False)}
    up = networks.dominant_direction(discs, labels)
    assert {r.scenario for r in screening.scenario(up, (0.0, 0.0, 1.0), ("good", "middle", "poor")).collect()} == {"poor"}


def test_generated_networks(spark):
    sets = spark.createDataFrame([(0, *unit(60, 30), 40.0, 0.7), (1, *unit(10, 200), 200.0, 0.3)], "set_id int, mx double, my double, mz double, kappa double, proportion double")
    runs = spark.createDataFrame([(0, 0.4, 1), (1, 0.4, 2), (2, 0.0, 1)], "net long, p32 double, seed int")
    box = (20.0, 20.0, 20.0)
    discs = networks.generate(spark, sets, runs, box)
    area = {r.net: r.a for r in discs.groupBy("net").agg((F.sum(F.col("radius") * F.col("radius") * math.pi) / 8000).alias("a")).collect()}
    assert set(area) == {0, 1} and all(abs(a - 0.4) < 0.12 for a in area.values())
    share = {r.set_id: r["count"] for r in discs.groupBy("set_id").count().collect()}
    assert share[0] / (share[0] + share[1]) == pytest.approx(0.7, abs=0.06)
    tilt = discs.filter("set_id = 1").select(F.avg(angles.angle(angles.vector(), angles.literal(unit(10, 200))))).first()[0]
    assert tilt == pytest.approx(math.degrees(math.sqrt(math.pi / 2 / 200)), rel=0.2)
    assert sorted(discs.collect()) == sorted(networks.generate(spark, sets, runs.repartition(3), box).collect())
    with pytest.raises(ValueError):
        networks.power_law_radius(F.lit(0.5), float("nan"), 1, 2)


def test_curve(spark):
    rows = [("a", 1.0, 0.0), ("a", 2.0, 0.25), ("a", 3.0, 0.75), ("b", 1.0, 0.6), ("b", 2.0, 0.9), ("c", 1.0, 0.1), ("c", 4.0, 0.2)]
    got = {r.k: r["at"] for r in ordered.crossing(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", 0.5).collect()}
    assert got == {"a": 2.5, "b": 1.0, "c": 4.0}


def test_straight_paths(spark):
    rows = [("v", i, i * 10.0, 0.0, 0.0) for i in range(5)] + [("h", i, i * 10.0, 90.0, 90.0) for i in range(5)]
    path = ordered.trajectory(spark.createDataFrame(rows, "well string, row_id long, md double, hazi double, hdev double"), ["well"])
    last = {r.well: (r.east, r.north, r.up) for r in path.filter("row_id = 4").collect()}
    assert last["v"] == pytest.approx((0, 0, -40)) and last["h"] == pytest.approx((40, 0, 0), abs=1e-9)
    t = ordered.tangents(path, ["well"]).filter("well = 'h'").collect()
    assert all(r.tx == pytest.approx(1, abs=1e-9) for r in t)


def test_terzaghi_favours_planes_along_the_hole(spark):
    df = spark.createDataFrame([(0, 1, *unit(85, 0)), (0, 2, *unit(5, 0)), (0, 3, *unit(10, 90))], "well int, row_id long, nx double, ny double, nz double")
    w = {r.row_id: r.w for r in aggregates.terzaghi(df, ["well"]).collect()}
    assert w[1] > w[3] > w[2]
    assert quality.censored(df).count() == 2


def test_sensitivity_has_45_cases(spark):
    bands = spark.createDataFrame([(1.0, 2.0, 0.1, 0.5, "low"), (1.0, 2.0, 3.0, 4.0, "high"), (1.0, 2.0, 1.2, 1.4, "high")], "crit_lo double, crit_hi double, est_lo double, est_hi double, escape string")
    assert screening.sensitivity(bands).count() == 135
    assert [r.grade for r in screening.disposal_grades(bands).collect()] == ["suitable", "unsuitable", "unsuitable"]


def test_csv_logs(spark, tmp_path):
    (tmp_path / "one.csv").write_text("﻿深度(m),倾角(°),倾向(°)\n1,30,40\n2,x,50\n3,40,inf\n2,35,45\n", encoding="utf-8")
    got = {r.depth: (r.well, r.dip, r.dip_dir) for r in logs.read_log(spark, str(tmp_path)).collect()}
    assert got[1.0] == ("one", 30.0, 40.0) and got[3.0][2] is None
    assert logs.find_columns(["ID", "Depth [m]", "Dip_Direction", "DIP", "Well"]) == {"depth": "Depth [m]", "dip": "DIP", "dip_dir": "Dip_Direction", "well": "Well"}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no column for"):
        logs.read_log(spark, str(tmp_path / "bad"))


def test_other_readers(spark, tmp_path):
    (tmp_path / "t.geojson").write_text('{"features": [{"geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 0], [2, 0]]}, "properties": {"Id": 7}}, {"geometry": {"type": "Point", "coordinates": []}, "properties": {}}]}')
    r = logs.read_traces(spark, str(tmp_path / "t.geojson")).first()
    assert (r.trace_id, r.px, r.strike, r.set_id) == (7, 1.0, 90.0, 2) and abs(r.ny) == pytest.approx(1)
    (tmp_path / "w.las").write_text("~VERSION\n VERS. 2.0 :\n~CURVE\n TDEP.FT : depth\n Azimuth.DEG : a\n Dip_TRU.DEG : d\n Type. : t\n~ASCII\n100 20 30 \"Tensile x\"\n101 25 35 natural\n102 1 2 Bedding\nbad row\n")
    got = logs.read_las(spark, str(tmp_path / "w.las")).collect()
    assert [(x.md, x.azimuth, x.dip, x.hazi, x.ftype) for x in got] == [(100.0, 20.0, 30.0, 0.0, "induced"), (101.0, 25.0, 35.0, 0.0, "natural")]
    for name, body in (("normal_vectors", "0 0 1\n1 0 0\n"), ("translations", "x y z\n1 2 3\n4 5 6\n"), ("radii_Final", "xr yr\n2 3\n5 4\n")):
        (tmp_path / f"{name}.dat").write_text(body)
    net = {x.id: (x.nz, x.px, x.radius) for x in logs.read_network_dir(spark, str(tmp_path)).collect()}
    assert net == {0: (1.0, 1.0, 3.0), 1: (0.0, 4.0, 5.0)}
    text = spark.createDataFrame([("2 {1,2,3} {4, 5, 6}",), ("3 {1,2,3}",)], "s string").select(logs.polygon(F.col("s")).alias("p")).collect()
    assert [tuple(x) for x in text[0].p] == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)] and text[1].p is None
    wells = spark.createDataFrame([("w", [[0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]])], "well string, normals array<array<double>>")
    assert [(x.depth, x.dip) for x in logs.normals_to_log(wells).collect()] == [(0.0, 0.0), (50.0, 90.0)]


def test_sinks(spark, tmp_path):
    ok = spark.createDataFrame([(1.0, 0)], "mae_mean double, poison_leaks int")
    assert sinks.save_result(ok, str(tmp_path / "r")).endswith("r")
    assert sinks.load_baseline(spark.read.json(str(tmp_path / "r"))) == 1.0
    bad = ok.withColumn("poison_leaks", F.lit(2))
    with pytest.raises(ValueError):
        sinks.save_result(bad, str(tmp_path / "s"))
    assert sinks.save_result(bad, str(tmp_path / "s"), force=True).endswith(".poison")
    with pytest.raises(ValueError):
        sinks.load_baseline(bad)
    with pytest.raises(Exception, match="is not finite"):
        sinks.finite(ok.withColumn("mae_mean", F.lit(float("nan")))).collect()
    disc = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 2.0)], "px double, py double, pz double, nx double, ny double, nz double, radius double")
    ring = sinks.disc_polygons(disc).first().polygon
    assert len(ring) == 12 and all(math.hypot(p.x, p.y) == pytest.approx(2) and p.z == pytest.approx(0) for p in ring)


def test_streams(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 2).alias("well"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), *(F.lit(x).alias(c) for x, c in zip(unit(60, 30), ("nx", "ny", "nz"))))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counts = streams.running_sets(streams.assign_stream(stream, [unit(60, 30), unit(10, 10)]))
    q = counts.writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("running").collect()
    assert sum(r.n for r in got) == 40 and {r.set_id for r in got} == {0}
    assert streams.drilling_runs(rows, "5 minutes").count() == 2


def test_median_has_the_least_sum_of_angles():
    """Against a fine search of the half sphere."""
    rng = np.random.default_rng(1)
    i = np.arange(40000) + 0.5
    z, a = 1 - i / 40000, np.pi * (1 + 5**0.5) * i
    sphere = np.stack([np.sqrt(1 - z * z) * np.cos(a), np.sqrt(1 - z * z) * np.sin(a), z], axis=1)
    for _ in range(15):
        n = rng.normal(size=(12, 3)) + np.array([0, 0, 3.0]) * rng.random()
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        w = rng.random((1, 12)) + 0.1
        cost = lambda v, w=w, n=n: (w * np.arccos(np.minimum(1, np.abs(v @ n.T)))).sum(axis=1)
        got = cost(predict.projective_median(n, w, predict.global_median(n)))[0]
        assert got <= cost(sphere).min() * 1.12


def test_mixture_finds_two_sets(spark):
    rng = random.Random(3)
    rows = [("w", i, *x) for i, x in enumerate(family(rng, 50, 100, 300, 4) + family(rng, 20, 250, 100, 4))]
    df = spark.createDataFrame(rows, "net string, id long, nx double, ny double, nz double")
    model = clusters.em_mixture(df, clusters.starting_centers(df, 2), 12)
    table = clusters.decoded(model).orderBy("set_id").collect()
    assert [round(r.share, 1) for r in table] == [0.7, 0.3] or abs(table[0].share - 0.75) < 0.03
    for r, (d, a) in zip(table, ((50, 100), (20, 250))):
        assert np.degrees(np.arccos(min(1, abs(np.dot(unit(r.dip, r.dip_dir), unit(d, a)))))) < 2 and r.enough and r.kappa > 20
    # against a plain version of the same rounds
    n = np.array([r[2:] for r in rows])
    c = np.array([[x.x, x.y, x.z] for x in clusters.starting_centers(df, 2).first().centers])
    kappa, share = np.full(2, 10.0), np.full(2, 0.5)
    for _ in range(12):
        z = np.array([(np.exp(k * (clusters._T**2 - 1)) * clusters._W).sum() for k in kappa])
        p = share / z * np.exp(kappa * ((n @ c.T) ** 2 - 1))
        p /= p.sum(axis=1, keepdims=True)
        for k in range(2):
            values, vectors = np.linalg.eigh((p[:, k, None] * n).T @ n / p[:, k].sum())
            c[k], kappa[k] = vectors[:, 2], clusters.solve_kappa(values[2:])[0]
        share = p.mean(axis=0)
    got = {r.k: r for r in model.collect()}
    for k in range(2):
        assert got[k].share == pytest.approx(share[k], abs=1e-6) and got[k].kappa == pytest.approx(kappa[k], rel=1e-5)
        assert abs(np.dot((got[k].cx, got[k].cy, got[k].cz), c[k])) == pytest.approx(1, abs=1e-9)


def test_kappa_is_solved():
    k = np.array([0.6, 3.0, 50.0, 300.0])
    assert clusters.solve_kappa(clusters.axial_moment(k)) == pytest.approx(k, rel=1e-6)


def test_new_predictors_do_not_read_hidden_normals(spark):
    df, _, _ = points(spark)
    centers = [unit(60, 30), unit(45, 150), unit(70, 280)]
    for f in (lambda x: predict.set_aware_observed(x, centers), lambda x: predict.top_two(x, centers, 9), lambda x: predict.fused([predict.top_two(x, centers, 9), predict.nearest_direction(x)])):
        named = lambda x, f=f: f(x).withColumnsRenamed({f"q{c}": f"p{c}" for c in "xyz"})
        changed = quality.leaks(named(predict.blind(df)), named(predict.poisoned(df, 1)))
        assert [r.n_changed for r in changed.collect()] == [0, 0]


def test_headers_of_other_logs_and_skipped_rows(spark, tmp_path):
    assert logs.find_columns(["孔深(m)", "倾角(°)", "方位角", "孔号"]) == {"depth": "孔深(m)", "dip": "倾角(°)", "dip_dir": "方位角", "well": "孔号"}
    assert logs.find_columns(["mdepth", "dip_angle", "trend", "井名"]) == {"depth": "mdepth", "dip": "dip_angle", "dip_dir": "trend", "well": "井名"}
    (tmp_path / "a.csv").write_text("well,depth,dip,azimuth\nw,1,2,3\nw,x,2,3\nv,1,1,1\n")
    assert {tuple(r) for r in logs.skipped_rows(logs.read_log(spark, str(tmp_path / "a.csv"))).collect()} == {("w", 2, 1), ("v", 1, 0)}
    (tmp_path / "b.csv").write_text("well,depth,dip,azimuth\nw,x,2,3\n")
    with pytest.raises(Exception, match="no row of well w"):
        logs.skipped_rows(logs.read_log(spark, str(tmp_path / "b.csv"))).collect()


def test_components_of_structs(spark):
    from strikeplane.operators.components import components

    edges = spark.createDataFrame([(("x", i), ("x", i + 1)) for i in range(40)] + [(("y", 5), ("y", 3))], "a struct<n:string,i:int>, b struct<n:string,i:int>")
    got = {tuple(r.node): tuple(r.label) for r in components(edges).collect()}
    assert all(got["x", i] == ("x", 0) for i in range(41)) and got["y", 5] == ("y", 3)
