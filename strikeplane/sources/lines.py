"""Lines of text files with their place in the file, however the files are split, and the layout that each file's header gives."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import written

#: What bytes are that are no UTF-8: the encoding that holds those of older Chinese tables.
FALLBACK = "gb18030"


def _decoded(value: bytes, plain: bool, encoding: str | None, name: str) -> str:
    codec = encoding or ("utf-8" if plain else FALLBACK)
    try:
        return bytes(value).decode(codec).lstrip("﻿")
    except UnicodeDecodeError as err:
        raise ValueError(f"{name} is not encoded as {codec}") from err


def numbered_lines(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines (file, name, place, value) and files (file, name, lines, plain, head) of a text file or a folder of them.

    place counts all lines of a file from 0. Files are read in splits: lines are counted for each block first, and a
    line's place is what lies in blocks before it and how far it is behind the first of its own block, which one task
    reads in order; so lines are neither shuffled nor sorted, and a task holds none. A file that is no UTF-8 as a whole is read as FALLBACK, and fails if it isn't that either;
    a given encoding is that of all files. head is the bytes of the first line; a file without lines has no row.
    """
    meta = F.col("_metadata")
    raw = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_name"].alias("name"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("seen"), "value")
    blocks = written(raw.groupBy("file", "name", "block").agg(F.count("*").alias("n"), F.min("seen").alias("first"), F.max("seen").alias("last"), F.bool_and(F.is_valid_utf8("value")).alias("plain")), "log-blocks")
    files = blocks.groupBy("file", "name").agg(F.sum("n").alias("lines"), F.bool_and("plain").alias("plain"))
    # a smallest line as an aggregate would sort all lines of a task; the first is looked up by its number
    starts = blocks.filter("block = 0").select("file", F.col("first").alias("seen"))
    heads = raw.filter("block = 0").join(starts, ["file", "seen"]).select("file", F.col("value").cast("binary").alias("head"))
    files = written(files.join(heads, "file", "left"), "log-files")
    ordered = Window.partitionBy("file").orderBy("block")
    before = blocks.select("file", "block", "first", "last", (F.sum("n").over(ordered) - F.col("n")).alias("before")).join(files.select("file", "plain"), "file")
    # both readings must have split the files alike
    rank = F.when(F.col("seen").between(F.col("first"), F.col("last")), F.col("seen") - F.col("first")).otherwise(F.raise_error(F.lit("files were split in another way the second time")).cast("long"))
    lines = raw.join(before, ["file", "block"], "left").withColumn("place", (F.col("before") + rank).cast("long"))
    as_is = lines.filter(F.coalesce("plain", F.lit(True))) if encoding is None else lines.limit(0)
    out = as_is.select("file", "name", "place", F.regexp_replace("value", "^﻿", "").alias("value"))
    if encoding is not None or not files.filter("not plain").isEmpty():

        def read(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in found:
                yield pdf.assign(value=[_decoded(v, False, encoding, n) for v, n in zip(pdf["value"], pdf["name"])])

        other = lines if encoding is not None else lines.filter("not plain")
        told = other.select("file", "name", "place", F.col("value").cast("binary").alias("value")).mapInPandas(read, "file string, name string, place long, value string")
        out = told if encoding is not None else out.unionByName(told)
    return out, files


def cells_by_header(spark: SparkSession, path: str | list[str], find: Callable[[list[str]], dict[str, str]], wanted: tuple[str, ...], needed: tuple[str, ...], encoding: str | None = None) -> DataFrame:
    """(file, name, row_id, and a string for each of `wanted`) of comma-separated files, each by its own first line.

    find tells which header stands for what. A file that lacks one of `needed` fails here, by name. row_id is the
    row's place in its file, 0 for the line after the header; blank lines count but give no row. A cell may be in
    quotes, but not hold a line break. A row with fewer cells has nulls.
    """
    lines, files = numbered_lines(spark, path, encoding)

    def laid_out(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            out = []
            for file, name, plain, head in zip(pdf["file"], pdf["name"], pdf["plain"], pdf["head"]):
                header = next(csv.reader([_decoded(head, plain, encoding, name)]), [])
                columns = find(header)
                missing = ", ".join(sorted(set(needed) - set(columns)))
                out.append((file, len(header), f"no column for {missing} among {header} in {name}" if missing else None, *(header.index(columns[w]) if w in columns else None for w in wanted)))
            made = pd.DataFrame(out, columns=["file", "width", "fault", *(f"at_{w}" for w in wanted)])
            yield made.astype({f"at_{w}": "Int32" for w in wanted})

    layouts = written(files.mapInPandas(laid_out, "file string, width int, fault string, " + ", ".join(f"at_{w} int" for w in wanted)), "log-layouts")
    fault = layouts.filter("fault is not null").select("fault").first()
    if fault:
        raise ValueError(fault[0])
    width = layouts.agg(F.max("width")).first()[0] or 1
    parsed = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)))
    body = lines.filter((F.col("place") > 0) & (F.trim("value") != "")).withColumn("cells", parsed).withColumn("cells", F.array(*(F.col(f"cells.c{i}") for i in range(width))))
    return body.join(layouts, "file").select("file", "name", (F.col("place") - 1).alias("row_id"), *(F.get("cells", F.col(f"at_{w}")).alias(w) for w in wanted))
