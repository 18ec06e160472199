"""Intrinsic means, resampled intervals, axes, gates, weighted k-means and grids of k against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeplane.operators import aggregates, clusters, decoding, means, predict


def normals(rng, center, n, spread):
    x = np.asarray(center, float) + rng.normal(0, spread, (n, 3))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * rng.choice([-1, 1], (n, 1))


def frame(spark, groups, weights=None):
    rows = [(g, i, *map(float, v), float(weights[g][i]) if weights else 1.0) for g, x in groups.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "net int, row_id long, nx double, ny double, nz double, wt double").repartition(3)


def best_on_sphere(x, w, power):
    """The direction of least weighted sum of angles to a power, by a grid and then finer ones around its best."""
    best, step = np.array([0.0, 0.0, 1.0]), 1.0
    for _ in range(24):
        a, b = np.eye(3)[np.abs(best).argmin()], None
        a = np.cross(best, a) / np.linalg.norm(np.cross(best, a))
        b = np.cross(best, a)
        grid = np.array([best + step * (p * a + q * b) for p in np.linspace(-1, 1, 21) for q in np.linspace(-1, 1, 21)])
        grid /= np.linalg.norm(grid, axis=1, keepdims=True)
        cost = (w[None] * np.arccos(np.clip(np.abs(grid @ x.T), 0, 1)) ** power).sum(axis=1)
        best, step = grid[cost.argmin()], step * 0.45
    return best


def test_means_and_medians_are_least_on_the_sphere(spark):
    rng = np.random.default_rng(3)
    groups = {i: normals(rng, rng.normal(size=3), 40, s) for i, s in enumerate((0.1, 0.2, 0.35))}
    weights = {i: rng.uniform(0.2, 3, 40) for i in groups}
    df = frame(spark, groups, weights).unionByName(spark.createDataFrame([(9, 0, None, None, None, 1.0)], "net int, row_id long, nx double, ny double, nz double, wt double"))
    for power, found in ((2, means.frechet_means(df, ["net"], "wt")), (1, means.median_directions(df, ["net"], "wt", eps=1e-6))):
        got = {r.net: np.array([r.mx, r.my, r.mz]) for r in found.collect()}
        assert set(got) == set(groups)
        for i, x in groups.items():
            want = best_on_sphere(x, weights[i], power)
            assert math.degrees(math.acos(min(1, abs(got[i] @ want)))) < (0.02 if power == 2 else 0.3)
    one = means.frechet_means(frame(spark, {1: np.array([[0.6, 0.0, -0.8]])}), ["net"]).first()
    assert abs(one.mx * 0.6 - one.mz * 0.8) == pytest.approx(1)
    assert means.frechet_means(df.limit(0), ["net"]).count() == 0


def intrinsic_mean(x):
    m = np.linalg.eigh(x.T @ x)[1][:, -1]
    for _ in range(60):
        y = x * np.where(x @ m < 0, -1, 1)[:, None]
        c = np.clip(y @ m, 0, 1)
        s = np.sqrt(1 - c * c)
        t = (np.where(s > 1e-8, np.arccos(c) / np.maximum(s, 1e-12), 0)[:, None] * (y - c[:, None] * m)).mean(axis=0)
        z = np.linalg.norm(t)
        if z < 1e-9:
            break
        m = np.cos(z) * m + np.sin(z) * t / z
    return m


def test_cones_are_those_of_resampling(spark):
    rng = np.random.default_rng(5)
    groups = {0: normals(rng, (0, 1, 1), 60, 0.15), 1: normals(rng, (1, 0, 0), 25, 0.3), 2: normals(rng, (1, 1, 0), 2, 0.1)}
    got = {r.net: (r.n, r.cone) for r in means.bootstrap_cone(frame(spark, groups), ["net"], 1500).collect()}
    assert got[2] == (2, 180.0)
    interval = {r.net: r for r in means.modal_interval(frame(spark, groups), ["net"], 1500).collect()}
    for i in (0, 1):
        x, center = groups[i], intrinsic_mean(groups[i])
        draws = [x[rng.integers(0, len(x), len(x))] for _ in range(1500)]
        off = np.degrees([math.acos(min(1, abs(intrinsic_mean(d) @ center))) for d in draws])
        assert got[i][0] == len(x) and got[i][1] == pytest.approx(np.quantile(off, 0.95), rel=0.1)
        mean = lambda d, c=center: (lambda s: s / np.linalg.norm(s))((d * np.where(d @ c < 0, -1, 1)[:, None]).sum(axis=0))
        modal = np.degrees([math.acos(min(1, abs(mean(d) @ mean(x)))) for d in draws])
        assert interval[i].ci_half_width == pytest.approx(np.quantile(modal, 0.975), rel=0.12)
        assert interval[i].ci_low <= interval[i].ci_high == interval[i].ci_half_width


def test_newton_step_equals_the_resamples_own_mean():
    rng = np.random.default_rng(8)
    x = normals(rng, (0.3, 0.2, 1), 200, 0.25)
    m = intrinsic_mean(x)
    w = rng.poisson(1, 200).astype(float)
    sums = means._features(x, np.broadcast_to(m, x.shape), w, True).sum(axis=0)[None]
    want = math.degrees(math.acos(min(1, abs(intrinsic_mean(np.repeat(x, w.astype(int), axis=0)) @ m))))
    assert means._offsets(sums, m, True)[0] == pytest.approx(want, rel=0.02)


def test_axes_at_rows(spark):
    stations = [("bent", i, 10.0 * i, 90.0, 3.0 * i) for i in range(20)] + [("straight", i, 5.0 * i, 45.0, 30.0) for i in range(8)] + [("one", 0, 3.0, 0.0, 0.0)]
    survey = spark.createDataFrame(stations, "well string, row_id long, md double, hazi double, hdev double").repartition(3)
    depths = [-5.0, 0.0, 9.99, 10.0, 55.5, 190.0, 500.0, None]
    log = spark.createDataFrame([(w, i, d, 0.0, 0.6, 0.8) for w in ("bent", "straight", "one", "none") for i, d in enumerate(depths)], "well string, row_id long, depth double, nx double, ny double, nz double")
    got = {(r.well, r.row_id): r for r in decoding.row_axes(log, survey).collect()}
    assert len(got) == 4 * len(depths)
    from strikeplane.operators import ordered

    path = {r.md: (r.tx, r.ty, r.tz) for r in ordered.tangents(ordered.trajectory(survey, ["well"]), ["well"]).filter("well = 'bent'").collect()}
    for i, d in enumerate(depths[:-1]):
        at = max((m for m in path if m <= d), default=0.0)
        assert (got["bent", i].ax, got["bent", i].ay, got["bent", i].az) == pytest.approx(path[at])
        assert got["bent", i].axis_source == "trajectory_tangent" and got["straight", i].axis_source == "trajectory_straight"
        u = abs(got["straight", i].ax * 0.5 * math.sqrt(0.5) + got["straight", i].ay * 0.5 * math.sqrt(0.5) - got["straight", i].az * math.sqrt(0.75))
        assert u == pytest.approx(1)
    assert got["bent", 7].axis_source == got["one", 2].axis_source == got["none", 2].axis_source == "unavailable"
    told = decoding.gated_weights(decoding.row_axes(log, survey)).groupBy("well").agg(F.first("reason").alias("reason"), F.max("w").alias("w")).collect()
    assert {r.well: (r.reason, r.w) for r in told if r.well != "straight"} == {w: ("no_well_axis", 1.0) for w in ("bent", "one", "none")}
    given = decoding.row_axes(log, survey, (0.0, 0.0, 2.0)).first()
    assert (given.az, given.axis_source) == (1.0, "explicit")


def test_gate_and_decoded_table(spark):
    rng = np.random.default_rng(2)
    fine = np.concatenate([normals(rng, (0, 0, 1), 120, 0.08), normals(rng, (1, 0, 1), 80, 0.08)])
    long_tail = np.concatenate([normals(rng, (0, 0, 1), 190, 0.02), normals(rng, (1, 0, 0.002), 10, 0.001)])
    df = frame(spark, {0: fine, 1: long_tail}).withColumnRenamed("net", "well").withColumn("depth", F.col("row_id") * 1.0)
    weighed = decoding.gated_weights(decoding.row_axes(df, axis=(0.0, 0.0, 1.0)), least_share=0.5)
    share = {r.well: (r.s, r.u, r.why) for r in weighed.groupBy("well").agg(F.first("ess_share").alias("s"), F.first("weights_used").alias("u"), F.first("reason").alias("why")).collect()}
    raw = 1 / np.maximum(1e-6, np.abs(fine[:, 2]))
    w = np.clip(raw / raw.mean(), 0.1, 5)
    assert share[0][0] == pytest.approx(w.sum() ** 2 / (w * w).sum() / len(w)) and share[0][1:] == ("terzaghi", None)
    tight = decoding.gated_weights(decoding.row_axes(df, axis=(0.0, 0.0, 1.0)), least_share=0.999)
    assert {(r.weights_used, r.reason, r.w) for r in tight.select("weights_used", "reason", "w").distinct().collect()} == {("none", "terzaghi_ess_below_gate", 1.0)}
    table = decoding.decode(weighed.filter("well = 0"), 2).orderBy("set_id").collect()
    assert [r.n_points for r in table] == [120, 80] and sum(r.share for r in table) == pytest.approx(1)
    assert table[1].dip == pytest.approx(45, abs=3) and table[0].axis_source == "explicit"
    assert table[1].share == pytest.approx(w[120:].sum() / w.sum(), abs=0.02)  # planes along the hole count for more


def test_weighted_reassignment_moves_rows(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([normals(rng, (0, 0, 1), 50, 0.2), normals(rng, (0, 1, 0.3), 50, 0.2)])
    df = frame(spark, {0: x}).withColumnsRenamed({"net": "well"}).withColumn("set_id", F.when(F.col("row_id") % 2 == 0, 0).otherwise(1)).withColumn("w", F.lit(1.0) + F.col("row_id") % 3)
    got = decoding.reassigned(df).collect()
    weight, sets = {r.row_id: r.w for r in got}, {r.row_id: r.new_set_id for r in got}
    for k in (0, 1):
        own = [i for i in sets if sets[i] == k]
        center = np.linalg.eigh(sum(weight[i] * np.outer(x[i], x[i]) for i in own))[1][:, -1]
        mean = sum(weight[i] * x[i] * (1 if x[i] @ center > 0 else -1) for i in own)
        for i in own:
            assert abs(x[i] @ mean) / np.linalg.norm(mean) >= 0.5


def test_grid_equals_one_k_at_a_time(spark):
    rng = np.random.default_rng(4)
    groups = {0: np.concatenate([normals(rng, c, 30, 0.1) for c in ((0, 0, 1), (1, 0, 0), (0, 1, 0))]), 1: normals(rng, (1, 1, 1), 3, 0.5)}
    df = frame(spark, groups).withColumnRenamed("row_id", "id")
    grid = clusters.grid_clusters(df, 2, 4, 5)
    scores = {(r.net, r.k): (r.n, r.silhouette, r.bic) for r in clusters.grid_scores(df, grid).collect()}
    for k in (2, 3, 4):
        alone = clusters.lloyd(df, clusters.starting_centers(df, k), 5)
        flat = lambda c: {r.net: [(x.x, x.y, x.z) for x in r.centers] for r in c.collect()}
        a, b = flat(alone), flat(grid[k])
        for net in a:
            assert np.asarray(a[net]) == pytest.approx(np.asarray(b[net]), abs=1e-12)
        placed = clusters.labelled(df, alone)
        both = clusters.silhouette(placed, ["net"]).join(clusters.mixture_bic(placed, ["net"], F.lit(k)).select("net", "bic"), "net")
        for r in both.collect():
            assert scores[r.net, k] == pytest.approx((r.n, r.silhouette, r.bic), abs=1e-9)
    chosen = clusters.choose_k(df, 2, 5, 6).filter("chosen").collect()
    assert {r.net: r.k for r in chosen}[0] == 3 and all(r.k < r.n for r in chosen)
    joint = clusters.joint_choose_k(df.withColumn("site", F.lit("s")), "site", 2, 4, 5).collect()
    assert {r.site for r in joint} == {"s"} and {r.n for r in joint} == {93} and [r.k for r in joint if r.chosen][0] in (3, 4)
    fused = {r.net: r for r in clusters.fused_k(clusters.choose_k(df, 2, 5, 6), df.withColumn("kind", F.when(F.col("id") < 20, "induced").when(F.col("id") < 80, "natural")), "kind", {"induced": 1}).collect()}
    assert (fused[0].k_data, fused[0].k, fused[0].per_kind) == (8, 3, {"induced": 1, "natural": 5})


def test_ensemble_on_observed_sets(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(80):
        side = i % 2
        v = normals(rng, (0, 0, 1) if side else (1, 0, 0), 1, 0.05)[0]
        rows.append((0, i, float(side * 10 + rng.random()), float(rng.random()), float(rng.random()), *map(float, v), i % 5 < 2 or i < 6))
    rows += [(1, i, float(i), 0.0, 0.0, 0.0, 0.6, 0.8, i < 2) for i in range(4)]
    df = spark.createDataFrame(rows, "net int, id long, px double, py double, pz double, nx double, ny double, nz double, is_obs boolean")
    for f in (predict.top_two_ensemble, lambda x: predict.set_aware_clustered(x, 2), predict.global_median_direction):
        got = predict.errors(f(predict.blind(df)), df).groupBy("net").agg(F.avg("error").alias("e"), F.count("*").alias("n")).collect()
        told = {r.net: r for r in got}
        assert told[0].n == sum(not r[-1] for r in rows if r[0] == 0) and told[1].n == 2
        assert told[1].e == pytest.approx(0, abs=1e-3)
        if f is not predict.global_median_direction:
            assert told[0].e < 8
    assert aggregates.bootstrap_cone.__doc__


def test_large_groups_are_resampled_in_parts(spark, monkeypatch):
    """A group in parts has the cone of the group whole, a null key is a group, and small groups leave no sums."""
    rng = np.random.default_rng(3)
    v = np.array([0.0, 0.0, 1.0]) + rng.normal(0, 0.2, (90, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [("a" if i < 60 else "b" if i < 80 else None, i, *map(float, x), 0.0, 0.0, 1.0) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "net string, row_id long, nx double, ny double, nz double, mx double, my double, mz double").repartition(5)
    told = lambda: {r.net: (r.n, r.cone, r.low, r.high) for r in means.resampled(df, ["net"], 100).collect()}
    whole = told()
    monkeypatch.setattr(means, "_PART", 25)
    parts = told()
    assert {k: x[0] for k, x in whole.items()} == {"a": 60, "b": 20, None: 10}
    assert {k: pytest.approx(x) for k, x in whole.items()} == parts


def test_scores_of_a_grid_make_no_row_for_each_model(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(v)], "net int, id long, nx double, ny double, nz double")
    found = clusters.nested_starts(df, (2, 3, 4))
    plan = clusters.grid_scores(df, found)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan
