"""Connected components of an edge table by alternating stars, over edges alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component for each node that an edge (a, b) ties to another.

    Nodes may be of any type that has an order, also structs. In a round every node's larger neighbours are tied
    to the least node around it, then every node and its smaller neighbours to the least of them; each round is
    written, and about log2 of the nodes of them suffice.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "components")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = star.groupBy("b").agg(F.min("a").alias("m"))
        flat = star.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b"))
        now = written(flat.filter("a < b").distinct(), "components")
        before, state = state, _state(now)
        if before == state:
            break
    labels = now.groupBy("b").agg(F.min("a").alias("label")).select(F.col("b").alias("node"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
