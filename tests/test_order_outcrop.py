"""Exact ranks and quantiles over ranges, and surfaces of outcrops, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeplane.operators import order, outcrop


def mean_ranks(x):
    x = np.asarray(x)
    return np.array([(x < a).sum() + ((x == a).sum() + 1) / 2 for a in x])


def test_quantiles_of_hot_groups_and_values(spark):
    rng = np.random.default_rng(1)
    groups = {"hot": np.round(rng.normal(size=3000), 2), "tied": np.full(500, 1.5), "few": np.array([3.0, 1.0]), "one": np.array([7.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [(None, 2.0), (None, 4.0), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r.g: r for r in order.with_quantiles(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect()}
        placed = order.positions(df, ["g"], "x").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g, xs in groups.items():
        assert (got[g].p10, got[g].p50, got[g].p90) == pytest.approx(tuple(np.quantile(xs, [0.1, 0.5, 0.9])))
    assert got[None].p50 == 3.0 and got["none"].p50 is None and got["none"].n == 2
    for r in placed:
        if r.g is not None:
            assert (r.n, r.before) == ((groups[r.g] == r.value).sum(), (groups[r.g] < r.value).sum())
    assert order.quantiles(df.limit(0), ["g"], "x", {"p": 0.5}).count() == 0


@pytest.mark.parametrize("most", [3, 10_000])
def test_ranks_and_correlations(spark, most):
    rng = np.random.default_rng(2)
    x, y, z = rng.integers(0, 9, 400).astype(float), rng.normal(size=400), np.full(400, 2.0)
    y = y - 0.4 * x
    df = spark.createDataFrame([("a", i, *map(float, t)) for i, t in enumerate(zip(x, y, z))] + [("b", 0, 1.0, 1.0, 1.0), ("b", 1, None, 2.0, 1.0)], "g string, id long, x double, y double, z double")
    ranks = {r.id: (r.rx, r.ry) for r in order.with_ranks(df, ["g"], {"x": "rx", "y": "ry"}, most).filter("g = 'a'").collect()}
    rx, ry = mean_ranks(x), mean_ranks(y)
    assert [ranks[i] for i in range(400)] == list(zip(rx, ry))
    got = {(r.g, r.proxy): r for r in order.rank_correlations(df, ["g"], "x", ["z", "y"]).collect()}
    assert got["a", "y"].rho == pytest.approx(np.corrcoef(rx, ry)[0, 1]) and got["a", "y"].best
    assert got["a", "z"].rho is None and not got["a", "z"].best
    assert got["b", "y"].n == 1 and not got["b", "y"].best


def sheet(rng, net, seg, normal, center, half, n, sets):
    normal = np.asarray(normal, float) / np.linalg.norm(normal)
    a = np.cross(normal, [0.3, 0.5, 0.2])
    a /= np.linalg.norm(a)
    b = np.cross(normal, a)
    p = center + rng.uniform(-half, half, (n, 1)) * a + rng.uniform(-half, half, (n, 1)) * b + rng.normal(0, 0.01, (n, 1)) * normal
    return [(net, seg, *map(float, x), sets[i % len(sets)]) for i, x in enumerate(p)], p


def plain_surface(p):
    c = p.mean(axis=0)
    n = np.linalg.eigh((p - c).T @ (p - c))[1][:, 0]
    n = -n if n[2] < 0 else n
    e1 = np.cross(n, [1, 0, 0] if abs(n[2]) < 0.9 else [0, 1, 0])
    e1 /= np.linalg.norm(e1)
    u, v = (p - c) @ e1, (p - c) @ np.cross(n, e1)
    return n, np.pi / 4 * np.ptp(u) * np.ptp(v), np.sqrt((((p - c) @ n) ** 2).mean()), np.abs((p - c) @ n).mean()


def test_surfaces_sets_and_intensity(spark):
    rng = np.random.default_rng(3)
    planes = [((0, 0, 1), (0, 0, 0), 2, 60, [1]), ((0.1, 0, -1), (0, 0, 9), 5, 80, [1, -1, 2, 2, 1]), ((1, 0.05, 0), (7, 0, 0), 3, 50, [2]), ((-1, 0, 0.02), (9, 5, 0), 1, 40, [2]), ((0, 1, 0), (0, 4, 4), 1, 5, [0]), ((1, 1, 1), (3, 3, 3), 2, 30, [-1])]
    rows, places = [], {}
    for seg, (normal, center, half, n, sets) in enumerate(planes):
        made, places[seg] = sheet(rng, 7, seg, normal, np.array(center, float), half, n, sets)
        rows += made
    rows += [(7, -1, 50.0, 0.0, 0.0, 1), (7, 8, 1.0, 1.0, 1.0, None), (7, 8, 2.0, 1.0, 1.0, None), (8, None, 0.0, 0.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "net int, seg_id int, px double, py double, pz double, set_id int").repartition(4)
    got = {r.seg_id: r for r in outcrop.surfaces(df).collect()}
    assert set(got) == {0, 1, 2, 3, 5} and {s: r.set_id for s, r in got.items()} == {0: 1, 1: 1, 2: 2, 3: 2, 5: -1}
    for s, r in got.items():
        n, area, rms, _ = plain_surface(places[s])
        assert abs(np.dot(n, (r.nx, r.ny, r.nz))) == pytest.approx(1, abs=1e-9) and r.nz >= 0
        assert (r.area, r.rms, r.n_points) == pytest.approx((area, rms, len(places[s])), rel=1e-6)
    found = outcrop.surfaces(df).cache()
    sets = {r.set_id: r for r in outcrop.set_summaries(found).collect()}
    assert set(sets) == {1, 2} and sets[1].n_surfaces == 2 and sets[1].total_points == 140
    for k, segs in ((1, (0, 1)), (2, (2, 3))):
        normals = np.array([plain_surface(places[s])[0] for s in segs])
        areas = np.array([plain_surface(places[s])[1] for s in segs])
        m = normals.T @ areas
        for _ in range(8):
            m = (normals * np.sign(normals @ m)[:, None]).T @ areas
        m /= np.linalg.norm(m)
        assert abs(np.dot(m, (sets[k].mx, sets[k].my, sets[k].mz))) == pytest.approx(1, abs=1e-9)
    every = np.array([r[2:5] for r in rows if r[0] == 7])
    p32 = {r.net: r for r in outcrop.outcrop_p32(found, df).collect()}
    assert p32[7].p32 == pytest.approx(sum(r.area for r in got.values()) / np.prod(np.ptp(every, axis=0))) and p32[8].n_surfaces == 0
    assert outcrop.outcrop_p32(found, df, (10, 10, 10)).filter("net = 7").first().volume == 1000
    gaps = {r.set_id: r for r in outcrop.surface_spacing(found).collect()}
    assert all(g.n == 1 for g in gaps.values()) and 2 in gaps
    quality = {(r.net, r.seg_id): (r.n, r.residual) for r in outcrop.segment_quality(df).collect()}
    assert quality[7, -1] == (1, None) and quality[7, 8] == (2, None) and quality[8, -1] == (1, None)
    assert quality[7, 2] == (50, pytest.approx(plain_surface(places[2])[3]))
    assert outcrop.surfaces(df.limit(0)).count() == 0 and outcrop.segment_quality(df.limit(0)).count() == 0


def test_normals_that_cancel_take_the_largest_surface(spark):
    df = spark.createDataFrame([(0, 1, 0, 0.0, 0.0, 1.0, 2.0, 5), (0, 1, 1, 0.0, 0.0, -1.0, 2.0, 5)], "net int, set_id int, seg_id int, nx double, ny double, nz double, area double, n_points long")
    r = outcrop.set_summaries(df).first()
    assert (r.mz, r.n_surfaces, r.dip) == (1.0, 2, 0.0)
