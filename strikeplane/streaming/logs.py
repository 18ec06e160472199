"""Logs that arrive as a stream: sets assigned row by row, and running counts in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import Center, assign


def assign_stream(rows: DataFrame, centers: list[Center]) -> DataFrame:
    """A stream of rows (nx, ny, nz) with set_id and angle. It keeps no state."""
    return assign(rows, centers)


def running_sets(assigned: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, well, set_id, n, mean_angle) of a stream with event time ts; rows later than `late` are left out."""
    return (
        assigned.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "well", "set_id")
        .agg(F.count("*").alias("n"), F.avg("angle").alias("mean_angle"))
        .select(F.col("window.start").alias("start"), "well", "set_id", "n", "mean_angle")
    )


def drilling_runs(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, well, n) of the sessions of a stream: rows of a well with no longer gap between them."""
    sessions = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "well").agg(F.count("*").alias("n"))
    return sessions.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "well", "n")
