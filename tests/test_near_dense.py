"""Nearest rows where an outlier, a dense spot or copies would fill one cell: the same as brute force."""

from __future__ import annotations

import random

import pytest

from strikeplane.operators import neighbours

PLACE = "net int, id long, px double, py double, pz double"


def brute(queries, data, k, own):
    out = set()
    for n, i, x, y, z in queries:
        if None in (n, x, y, z):
            continue
        near = sorted(((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2, j) for m, j, a, b, c in data if m == n and None not in (a, b, c) and (own or j != i))
        out |= {(n, i, r + 1, j) for r, (_, j) in enumerate(near[:k])}
    return out


def clouds():
    rng = random.Random(8)
    even = [(1, i, rng.random() * 9, rng.random() * 9, rng.random() * 9) for i in range(150)]
    spot = [(2, i, rng.random() * 1e-4, rng.random() * 1e-4, rng.random() * 1e-4) for i in range(260)]
    wide = [(2, 500 + i, rng.random() * 100, rng.random() * 100, rng.random() * 100) for i in range(60)] + [(2, 900, 1e6, 0.0, 0.0)]
    copies = [(3, i, 1.0, 2.0, 3.0) for i in range(200)] + [(3, 200 + i, float(i), 0.0, 0.0) for i in range(20)]
    odd = [(4, 1, 0.0, 0.0, 0.0), (5, 1, None, 0.0, 0.0), (5, 2, 1.0, 0.0, 0.0), (5, 3, 2.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0), (None, 2, 0.0, 0.0, 0.0)]
    return even + spot + wide + copies + odd


@pytest.mark.parametrize("k,own", [(1, False), (3, True), (6, False)])
def test_nearest_is_exact_whatever_the_density(spark, k, own):
    rows = clouds()
    df = spark.createDataFrame(rows, PLACE)
    got = neighbours.nearest(df, df, k, own)
    assert {(r.net, r.id, r.rank, r.other) for r in got.collect()} == brute(rows, rows, k, own)


def test_queries_apart_from_data_and_in_parts(spark, monkeypatch):
    rows, rng = clouds(), random.Random(9)
    asked = [(n, 10_000 + i, rng.random() * 300 - 100, rng.random() * 300 - 100, rng.random() * 9) for i, n in enumerate([1, 2, 3, 4, 6] * 8)]
    monkeypatch.setattr(neighbours, "_PART", 64)
    got = neighbours.nearest(spark.createDataFrame(asked, PLACE), spark.createDataFrame(rows, PLACE), 4)
    assert {(r.net, r.id, r.rank, r.other) for r in got.collect()} == brute(asked, rows, 4, False)


def test_dense_spots_narrow_the_cells(spark):
    rows = [r for r in clouds() if r[0] in (1, 2, 3)]
    places = spark.createDataFrame(rows, PLACE)
    sides = {r.net: r for r in neighbours._sides(places.dropDuplicates(["net", "px", "py", "pz"]), 1).collect()}
    assert sides[2]["__side"] < 1e-3 and sides[1]["__side"] > 1


def test_no_rows(spark):
    none = spark.createDataFrame([], PLACE)
    assert neighbours.nearest(none, none, 3).count() == 0
