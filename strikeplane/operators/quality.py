"""Cleaning of logs, masks of observed rows, and checks that fail loudly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles, grades
from .order import quantiles


def flagged(log: DataFrame) -> DataFrame:
    """log (well, row_id, depth, dip, dip_dir) with a `state`: null, out_of_range, duplicate or ok.

    Checks go in this order, a row counts once. Of rows with equal well, depth, dip and dip direction the first
    by row_id stays.
    """
    numbers = [F.col(c) for c in ("depth", "dip", "dip_dir")]
    missing = F.lit(False)
    for x in numbers:
        missing |= x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.col("dip").between(0, 90) & (F.col("dip_dir") >= 0) & (F.col("dip_dir") < 360)
    base = log.withColumn("well", F.trim(F.coalesce(F.col("well").cast("string"), F.lit("unnamed")))).withColumn("__base", F.when(missing, "null").when(~ok, "out_of_range").otherwise("ok"))
    same = Window.partitionBy("well", "depth", "dip", "dip_dir", "__base").orderBy("row_id")
    return base.withColumn("state", F.when((F.col("__base") == "ok") & (F.row_number().over(same) > 1), "duplicate").otherwise(F.col("__base"))).drop("__base")


def quality_report(marked: DataFrame) -> DataFrame:
    """A row for each well of flagged(): counts by state, whether depth never falls in row order, and a grade."""
    before = F.lag("depth").over(Window.partitionBy("well", F.col("state") == "ok").orderBy("row_id", "depth"))
    counts = marked.withColumn("falls", (F.col("state") == "ok") & (F.col("depth") < before))
    n = lambda state: F.count(F.when(F.col("state") == state, 1))
    report = counts.groupBy("well").agg(
        F.count("*").alias("n_rows"),
        n("null").alias("n_null"),
        n("out_of_range").alias("n_out_of_range"),
        n("duplicate").alias("n_duplicate"),
        n("ok").alias("n_ok"),
        F.count(F.when(F.col("falls"), 1)).alias("n_falls"),
    )
    return report.withColumn("monotone", F.col("n_falls") == 0).withColumn("grade", grades.quality_grade(F.col("n_ok")))


def clean(log: DataFrame) -> DataFrame:
    """The rows that pass, with their normals nx, ny, nz."""
    n = angles.normal(F.col("dip"), F.col("dip_dir"))
    return flagged(log).filter("state = 'ok'").drop("state").withColumns(dict(zip(("nx", "ny", "nz"), n)))


def censored(rows: DataFrame, axis: tuple[float, float, float] = (0.0, 0.0, 1.0), least_angle: float = 10.0) -> DataFrame:
    """Rows whose plane meets the borehole axis at least_angle degrees or more."""
    import math

    return rows.filter(F.abs(angles.dot(angles.vector(), angles.literal(axis))) >= math.sin(math.radians(least_angle)))


def chosen(key: Column, seed: int, share: float) -> Column:
    """Whether a row is in a share of rows that follows from its key and the seed alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)


def hide(rows: DataFrame, observed: str = "is_obs") -> DataFrame:
    """What a predictor may see: the normals of rows that are not observed are null."""
    return rows.withColumns({c: F.when(F.col(observed), F.col(c)) for c in ("nx", "ny", "nz")})


def spatial_block(rows: DataFrame, share: float = 0.4, turn: float = 30.0) -> DataFrame:
    """rows with is_obs: true for the share of each net that lies farthest along a direction `turn` degrees from x."""
    import math

    along = F.col("px") * math.cos(math.radians(turn)) + F.col("py") * math.sin(math.radians(turn))
    cut = quantiles(rows, ["net"], along, {"__cut": 1 - share})
    return rows.join(cut, "net").withColumn("is_obs", along >= F.col("__cut")).drop("__cut")


def checked_normals(rows: DataFrame, who: str) -> DataFrame:
    """rows, unchanged; reading one without a finite normal of some length fails with the caller's name."""
    n = angles.vector()
    bad = F.lit(False)
    for x in n:
        bad |= x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    bad |= angles.length(n) < 1e-12
    return rows.withColumn("nx", F.when(bad, F.raise_error(F.lit(f"{who}: a normal is missing, not finite or zero"))).otherwise(F.col("nx")))


def leaks(predicted: DataFrame, again: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(net, n_changed): predictions that moved between two runs that differ in hidden normals alone."""
    a = predicted.select("net", "id", *(F.col(f"p{c}").alias(f"a{c}") for c in "xyz"))
    b = again.select("net", "id", *(F.col(f"p{c}").alias(f"b{c}") for c in "xyz"))
    moved = F.greatest(*(F.abs(F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz")) > tolerance
    return a.join(b, ["net", "id"]).groupBy("net").agg(F.count(F.when(moved, 1)).alias("n_changed"))
