"""Connected components of an edge table, by alternating stars, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _toward_least(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the least node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _flatten(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them. Edges come as a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return (
        joined.select(F.col("m").alias("a"), F.col("a").alias("b"))
        .unionByName(least.select(F.col("m").alias("a"), "b"))
        .filter("a < b")
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the component, for each node that an edge (a, b) of longs names.

    Edges may repeat, come in either direction or tie a node to itself; such a node alone gets no row. Each
    round writes its edges to the shared folder, so a round lost with an executor starts from the round before.
    What joins on a node that very many edges have is a plain join without an order to keep, which adaptive
    execution splits.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "components")
    state = _state(now)
    while state[0]:
        now = materialize(_flatten(_toward_least(now)), "components")
        before, state = state, _state(now)
        if before == state:
            break
    labels = now.groupBy("b").agg(F.min("a").alias("label")).select(F.col("b").alias("node"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
