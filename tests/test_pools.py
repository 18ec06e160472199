"""Partners and pools by bounds, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeplane.operators import fusion, pools


def made(rng, mode, n):
    """n tables of one to five sets: all alike, around the same axes, or around axes of their own."""
    x, sizes, base = np.zeros((n, 5, 3)), np.zeros(n, dtype=int), rng.normal(size=(5, 3))
    for t in range(n):
        k = 4 if mode == "tight" else int(rng.integers(1, 6))
        v = (rng.normal(size=(5, 3)) if mode == "wild" else base)[:k] + rng.normal(0, 0.06 if mode == "tight" else 0.4, (k, 3))
        x[t, :k], sizes[t] = v / np.linalg.norm(v, axis=1, keepdims=True) * rng.choice([-1, 1], (k, 1)), k
    return x, sizes


def merged(n, ties):
    label = list(range(n))
    for a, b in ties:
        p, q = label[a], label[b]
        label = [min(p, q) if c in (p, q) else c for c in label]
    return label


@pytest.mark.parametrize("mode", ["tight", "mixed", "wild"])
def test_bounds_rule_out_no_partner_and_no_tie(mode):
    rng, n, h = np.random.default_rng(5), 240, 90
    x, sizes = made(rng, mode, n)
    names = np.array([f"w{i:03d}" for i in rng.permutation(n)], dtype=object)
    i, j = (g.ravel() for g in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    every = fusion._means_of(x[i], x[j], sizes[i], sizes[j]).reshape(n, n)
    block = pools._Block(x, sizes)
    assert (every - pools._least(block, np.arange(n), block, np.arange(n))).min() > -pools._SLACK / 2
    np.fill_diagonal(every, np.inf)
    want = [min((every[t, o], names[o]) for o in range(n)) for t in range(n)]
    label = merged(n, [(a, b) for a in range(n) for b in range(n) if every[a, b] < 20])
    matched = []

    def means(p, q, m, k):
        matched.append(len(p))
        return fusion._means_of(p, q, m, k)

    found, first = pools.within(means, block, names, np.ones(n), 35.0, 20.0)
    assert [(a, o) if o else None for a, o in zip(found.angle, found.name)] == [(pytest.approx(a), o) if a < 35 else None for a, o in want]
    assert len(set(zip(label, first))) == len(set(label)) == len(set(first))
    halves = [pools._Block(x[:h], sizes[:h]), pools._Block(x[h:], sizes[h:])]
    (fa, ga), (fb, gb) = (pools.within(means, b, names[s], np.ones(len(b.x)), 35.0, 20.0) for b, s in zip(halves, (slice(0, h), slice(h, n))))
    matched.clear()
    pa, pb, ties = pools.between(means, *halves, (names[:h], names[h:]), (fa.angle, fb.angle), (ga, gb), 35.0, 20.0)
    best = np.minimum(np.concatenate([fa.angle, fb.angle]), np.concatenate([pa.angle, pb.angle]))
    assert np.where(best < 35, best, 99) == pytest.approx([a if a < 35 else 99 for a, _ in want])
    got = merged(n, [*enumerate(ga), *((h + a, h + b) for a, b in enumerate(gb)), *((a, h + b) for a, b in ties)])
    assert len(set(zip(label, got))) == len(set(label)) == len(set(got))
    if mode == "tight":  # before, all pairs were matched
        assert sum(matched) < 0.2 * h * (n - h)


def test_pools_over_many_blocks_and_copies(spark, monkeypatch):
    """Blocks smaller than the tables, a third of which are copies of one; a table of nine sets."""
    rng = np.random.default_rng(7)
    rows = []
    for t in range(60):
        base = np.eye(4, 3) + 0.2 if t % 4 else rng.normal(size=(4, 3))
        for k in range(rng.integers(1, 5) if t != 13 else 9):
            x = base[k % 4] + rng.normal(0, 0.25 * (t % 3), 3)
            rows.append((t, k, *map(float, x / np.linalg.norm(x) * rng.choice([-1, 1]))))
    copied = [r for r in rows if r[0] == 20]
    rows += [(t, *r[1:]) for t in range(100, 130) for r in copied]
    tables = spark.createDataFrame(rows, "table long, set_id int, mx double, my double, mz double").cache()
    monkeypatch.setattr(pools, "_POOL_BLOCK", 9)
    pairs = fusion.consistency(fusion.matches(fusion.table_pairs(tables, "table")), sizes=tables.groupBy("table").agg(F.count("*").alias("k")))
    want = {r.table: (pytest.approx(r.best_angle, abs=1e-6), r.tier, r.pool) for r in fusion.joint_pools(pairs.filter("mean_angle < 35"), tables).collect()}
    got = {r.table: (r.best_angle, r.tier, r.pool) for r in fusion.agreeing_pools(tables).collect()}
    assert got == want and {"joint", "pair_only", "independent"} == {v[1] for v in got.values()}
