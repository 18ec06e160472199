"""Components of discs without the table of their overlaps, against all overlaps."""

from __future__ import annotations

import random

import numpy as np

from strikeplane.operators import neighbours, networks

DISC = "net int, id long, px double, py double, pz double, radius double"


def test_linked_discs_are_the_components_of_all_overlaps(spark):
    """Crowded, copied, far, point-like and null discs; also at the very reach, where discs do not overlap."""
    rng = random.Random(5)
    rows = []
    for net, (n, size) in enumerate(((200, 12.0), (200, 30.0), (60, 2.0))):
        spots = [[rng.choice((0.0, -0.0, rng.uniform(-size, size))) for _ in range(3)] for _ in range(n // 2)]
        rows += [(net, i, *rng.choice(spots), rng.choice((0.3, 0.5, 1.0, 1.7, 0.0))) for i in range(n)]
    rows += [(3, i, 2.0 * i, 0.0, 0.0, 1.0) for i in range(5)] + [(3, 10 + i, 1e15 + 0.5 * i, 0.0, 0.0, 1.0) for i in range(4)]
    rows += [(4, 0, None, 0.0, 0.0, 1.0), (4, 1, 0.0, 0.0, 0.0, None), (4, 2, 0.0, 0.0, 0.0, 1.0), (4, 3, 0.0, 0.0, 0.5, 1.0)]
    discs = spark.createDataFrame(rows, DISC).repartition(5)
    want = sorted(tuple(r) for r in networks.components(discs, neighbours.disc_edges(discs, 1.7)).collect())
    got = sorted(tuple(r) for r in networks.linked(discs, 1.7).collect())
    assert got == want and len(got) == len(rows)
    assert 1 < len({(n, c) for n, _, c in got}) < len(rows)


def test_discs_are_not_broadcast(spark, sf_dir):
    """Neither the pairs of discs nor their components may pass a side of the join whole through the driver."""
    from strikeplane.plans import registry

    for name in ("disc_edges", "periodic_edges"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_overlaps_are_all_pairs_in_any_box(spark, monkeypatch):
    """Crowded and split cells, copies, wrapped places, boxes of one, two and more cells, equal ids and null rows, against every two discs."""
    monkeypatch.setattr(neighbours, "_DISCS", 40)
    rng = random.Random(7)
    for box, size in ((None, 9.0), ((3.0, 8.0, 30.0), 8.0), ((12.0, 12.0, 12.0), 12.0)):
        rows = [(net, i % 290, *(rng.uniform(0, size) if i % 3 else 1.5 for _ in range(3)), rng.choice((0.1, 0.4, 1.0, 1.7))) for net in ("a", "b") for i in range(300)]
        rows += [("a", 1000, None, 0.0, 0.0, 1.0), ("a", 1001, 0.0, 0.0, 0.0, None), (None, 1002, 0.0, 0.0, 0.0, 1.0)]
        discs = spark.createDataFrame(rows, DISC.replace("net int", "net string")).repartition(5)
        want = []
        for x in rows:
            for y in rows:
                if None not in (*x, *y) and x[0] == y[0] and x[1] < y[1]:
                    off = [abs(p - q) for p, q in zip(x[2:5], y[2:5])]
                    off = off if box is None else [min(o, b - o) for o, b in zip(off, box)]
                    if sum(o * o for o in off) < (x[5] + y[5]) ** 2:
                        want.append((x[0], x[1], y[1]))
        assert sorted(map(tuple, neighbours.disc_edges(discs, 1.7, box).collect())) == sorted(want)


def test_a_disc_goes_to_the_cells_behind_it_alone(spark):
    """A disc went to all 27 cells around it, and each pair was looked at from both sides."""
    rng = random.Random(9)
    rows = [(0, i, *(rng.uniform(0, 100) for _ in range(3)), rng.uniform(1, 11)) for i in range(400)]
    own, visits = neighbours._disc_cells(spark.createDataFrame(rows, DISC), 22.0, (100.0,) * 3)
    assert own.count() == 400 and visits.count() < 8 * 400


def test_a_part_finds_all_overlaps_block_by_block():
    rng = np.random.default_rng(2)
    places, radius = rng.uniform(0, 25, (3, 1500)), rng.uniform(0.3, 2.7, 1500)
    part = neighbours._Discs(places[:, :750], radius[:750], (30.0,) * 3)
    got = [(int(y), int(x)) for a, b in part.overlaps(places[:, 750:], radius[750:]) for x, y in zip(a, b)]
    off = np.abs(places[:, :750, None] - places[:, None, 750:])
    near = (np.square(np.minimum(off, 30 - off)).sum(0) < np.square(radius[:750, None] + radius[750:])).nonzero()
    assert len(part.starts) > 10 and sorted(got) == sorted(zip(near[0].tolist(), near[1].tolist()))
