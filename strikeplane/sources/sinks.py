"""What is written: tables as CSV, JSON and Parquet, results behind a gate, and a set table as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles


def write_table(table: DataFrame, path: str, kind: str = "parquet") -> None:
    """A set table or any other result, by Spark's writer."""
    writer = table.write.mode("errorifexists")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        finite(table).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)


def finite(table: DataFrame) -> DataFrame:
    """table, unchanged; reading a NaN or an infinity fails."""
    def checked(c: str) -> Column:
        bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"{c} is not finite"))).otherwise(F.col(c)).alias(c)

    return table.select(*(checked(c) if t in ("double", "float") else F.col(c) for c, t in table.dtypes))


def save_result(result: DataFrame, path: str, force: bool = False) -> str:
    """Write an evaluation's result, unless a leak was found: then only if forced, and under another name."""
    leaked = not result.filter("poison_leaks > 0").isEmpty()
    if leaked and not force:
        raise ValueError("a predictor read hidden normals: its result is not written")
    target = f"{path}.poison" if leaked else path
    write_table(result, target, "json")
    return target


def load_baseline(result: DataFrame) -> float | None:
    """The mean error of a written result; None if it is empty, an error if it was poisoned."""
    row = result.select("mae_mean", "poison_leaks").first()
    if row is None:
        return None
    if row["poison_leaks"]:
        raise ValueError("a poisoned result is no baseline")
    return float(row["mae_mean"])


def nested(table: DataFrame, by: str) -> DataFrame:
    """(by, sets): a JSON text of each group's set rows, in the order of set_id. Groups have a few sets each."""
    rest = [c for c in table.columns if c != by]
    return table.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct("set_id", *(c for c in rest if c != "set_id"))))).alias("sets"))


def markdown(table: DataFrame, by: str) -> DataFrame:
    """(by, report): each group's set table as Markdown. Groups have a few sets each."""
    row = F.concat_ws(
        " | ",
        F.concat(F.lit("| "), F.col("set_id").cast("string")),
        angles.number_text(F.col("strike")),
        angles.number_text(F.col("dip_dir")),
        angles.number_text(F.col("dip")),
        F.col("n").cast("string"),
        F.concat(angles.number_text(F.col("proportion") * 100), F.lit(" |")),
    )
    lines = F.array_sort(F.collect_list(F.struct("set_id", row.alias("line"))))
    head = "| set | strike | dip direction | dip | n | percent |\n| --- | --- | --- | --- | --- | --- |\n"
    return table.groupBy(by).agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("report"))


def disc_polygons(discs: DataFrame, corners: int = 12) -> DataFrame:
    """discs with `polygon`, an array of struct(x, y, z) around each."""
    n = angles.vector()
    helper = tuple(F.when(F.abs(n[2]) < 0.9, F.lit(a)).otherwise(F.lit(b)) for a, b in ((0.0, 1.0), (0.0, 0.0), (1.0, 0.0)))
    e1 = angles.unit(angles.cross(helper, n), 1e-12)
    framed = discs.withColumns({f"__e{i}": x for i, x in enumerate(e1)})
    u = tuple(F.col(f"__e{i}") for i in range(3))
    v = angles.cross(n, u)

    def corner(i: Column) -> Column:
        a = i * (2 * 3.141592653589793 / corners)
        return F.struct(*((F.col(f"p{c}") + F.col("radius") * (F.cos(a) * u[j] + F.sin(a) * v[j])).alias(c) for j, c in enumerate("xyz")))

    return framed.withColumn("polygon", F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), corner)).drop("__e0", "__e1", "__e2")
