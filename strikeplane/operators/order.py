"""Exact ranks and quantiles of groups of any size: equal values are counted first, then ranges of values are sorted apart.

A group's values are dealt to tasks by ranges, so a group that holds a third of all rows is sorted by many tasks, and a
value that very many rows share is one row by then. What lies before a range is the sum of the ranges below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined to b on keys, of which null is one like others; a's columns and then b's others."""
    named = b.withColumnsRenamed({k: f"__b_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= a[k].eqNullSafe(named[f"__b_{k}"])
    return a.join(named, same, how).drop(*(f"__b_{k}" for k in keys))


def positions(rows: DataFrame, by: list[str], value: str | Column) -> DataFrame:
    """(by, value, n, before): each distinct value of a group, how many rows have it and how many have a smaller one.

    Rows whose value is null or NaN don't count. A null in by is a group like others.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counts = rows.select(*by, v.alias("value")).filter("value is not null and not isnan(value)").groupBy(*by, "value").agg(F.count("*").alias("n"))
    ranged = written(counts.repartitionByRange(*by, "value").withColumn("__range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*by, "__range").orderBy("value")
    ranges = ranged.groupBy(*by, "__range").agg(F.sum("n").alias("__n"), F.min("value").alias("__low"))
    below = Window.partitionBy(*by).orderBy("__low")
    offsets = ranges.select(*by, "__range", (F.sum("__n").over(below) - F.col("__n")).alias("__below"))
    told = _met(ranged.withColumn("before", F.sum("n").over(inside) - F.col("n")), offsets, [*by, "__range"])
    return told.select(*by, "value", "n", (F.col("before") + F.col("__below")).alias("before"))


def quantiles(rows: DataFrame, by: list[str], value: str | Column, shares: dict[str, float]) -> DataFrame:
    """(by, and a double for each of shares): interpolated quantiles of each group, named by shares; a group without values has no row."""
    placed = written(positions(rows, by, value), "positions")
    sizes = placed.groupBy(*by).agg(F.sum("n").alias("__size"))
    met = _met(placed, sizes, by)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("value")))

    parts, out = [], []
    for name, share in shares.items():
        place = (F.col("__size") - 1) * F.lit(float(share))
        parts += [at(F.floor(place)).alias(f"__lo_{name}"), at(F.ceil(place)).alias(f"__hi_{name}")]
        out.append((F.col(f"__lo_{name}") + (place - F.floor(place)) * (F.col(f"__hi_{name}") - F.col(f"__lo_{name}"))).alias(name))
    return met.groupBy(*by, "__size").agg(*parts).select(*by, *out)


def with_quantiles(stats: DataFrame, rows: DataFrame, by: list[str], value: str | Column, shares: dict[str, float]) -> DataFrame:
    """stats (by, ...) with the quantiles of rows; null for a group without values. Null keys are keys like others."""
    return _met(stats, quantiles(rows, by, value, shares), by, "left")


def with_ranks(rows: DataFrame, by: list[str], values: dict[str, str], most: int = 10_000) -> DataFrame:
    """rows with the rank from 1 of each value in its group, equal values sharing their mean rank; values maps columns to the ranks' names.

    Ranks come back by a join on group and value. Values that more than one in `most` of all rows has are at most
    `most`: they are broadcast, so no such value goes to one task. A null or NaN has no rank.
    """
    for column, name in values.items():
        placed = written(positions(rows, by, column).select(*by, F.col("value").alias("__v"), "n", (F.col("before") + (F.col("n") + 1) / 2).alias(name)), "ranks")
        total = placed.agg(F.sum("n")).first()[0] or 0
        keyed = rows.withColumn("__v", F.col(column).cast("double"))
        keys = [*by, "__v"]
        hot = F.broadcast(placed.filter(F.col("n") > total / most).drop("n"))
        cold = placed.filter(F.col("n") <= total / most).drop("n")
        often = _met(keyed, hot, keys)
        rest = _met(_met(keyed, hot.select(*keys), keys, "left_anti"), cold, keys, "left")
        rows = often.unionByName(rest).drop("__v")
    return rows


def rank_correlations(rows: DataFrame, by: list[str], x: str, ys: list[str]) -> DataFrame:
    """(by, proxy, n, rho, best): Spearman's correlation of x with each of ys in every group, and whether it is the strongest.

    Pairs with a null don't count for their proxy. Of equal strengths the first of ys is best; one without a
    correlation (a constant) is never best.
    """
    out = None
    for i, y in enumerate(ys):
        pairs = rows.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).filter("__x is not null and __y is not null and not isnan(__x) and not isnan(__y)")
        ranked = with_ranks(pairs, by, {"__x": "__rx", "__y": "__ry"})
        spread = F.var_pop("__rx") * F.var_pop("__ry")
        rho = F.when(spread > 0, F.covar_pop("__rx", "__ry") / F.sqrt(spread))
        one = ranked.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("rho")).select(*by, F.lit(y).alias("proxy"), F.lit(i).alias("__i"), "n", "rho")
        out = one if out is None else out.unionByName(one)
    strongest = F.row_number().over(Window.partitionBy(*by).orderBy(F.abs("rho").desc_nulls_last(), "__i"))
    return out.withColumn("best", (strongest == 1) & F.col("rho").isNotNull()).drop("__i")
