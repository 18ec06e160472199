"""Queries over all rows, where a sample or a smaller job once stood."""

from __future__ import annotations

import math
from itertools import combinations

import pytest

from strikeplane.operators import aggregates, clusters, networks, screening
from strikeplane.plans import registry


def test_excluded_volume_takes_every_disc(spark):
    radii = {"small": [1.0, 2.5], "large": [1 + (i * i % 97) / 10 for i in range(1300)], "one": [3.0]}
    discs = spark.createDataFrame([(net, i, x) for net, xs in radii.items() for i, x in enumerate(xs)], "net string, id long, radius double")
    got = {r.net: r.excluded for r in screening.excluded_volume(discs, (10.0, 10.0, 10.0)).collect()}
    assert set(got) == {"small", "large"}
    for net, found in got.items():
        xs = radii[net]
        pairs = [(a + b) ** 3 * 4 / 3 * math.pi for a, b in combinations(xs, 2)]
        assert found == pytest.approx(len(xs) / 1000 * sum(pairs) / len(pairs), rel=1e-9)


def test_cones_and_numbers_of_sets_are_registered_whole(spark, sf_dir, monkeypatch):
    asked = {}
    choose, cone = clusters.choose_k, aggregates.bootstrap_cone

    def spy(name, f, result):
        def call(*a, **k):
            import inspect

            asked[name] = inspect.signature(f).bind(*a, **k)
            asked[name].apply_defaults()
            return result

        return call

    some = spark.range(1)
    monkeypatch.setattr(clusters, "choose_k", spy("choose_k", choose, some))
    monkeypatch.setattr(aggregates, "bootstrap_cone", spy("cone", cone, some))
    registry.QUERIES["choose_k"](spark, sf_dir)
    registry.QUERIES["bootstrap_cone"](spark, sf_dir)
    found = asked["choose_k"].arguments
    assert (found["least"], found["most"], found["rounds"]) == (2, 8, 12)
    assert asked["cone"].arguments["resamples"] == 200


def test_a_network_too_large_fails(spark):
    sets = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 1.0, 10.0)], "set_id int, proportion double, mx double, my double, mz double, kappa double")
    runs = spark.createDataFrame([(0, 0.5, 0)], "net long, p32 double, seed int")
    with pytest.raises(Exception, match="may have 10 discs"):
        networks.generate(spark, sets, runs, (20.0, 20.0, 20.0), largest_n=10).collect()
    assert networks.generate(spark, sets, runs, (20.0, 20.0, 20.0)).count() > 10
