"""Logs and picks from CSV, trace windows from GeoJSON, normals from arrays: Spark's own readers, then columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import angles
from .lines import cells_by_header

# Names under which a log's columns may come, after normalising.
ALIASES = {
    "depth": ("depth", "md", "mdepth", "measured depth", "depth m", "深度", "孔深", "测深", "井深"),
    "dip": ("dip", "dip angle", "dip_angle", "dip deg", "dip_deg", "倾角", "倾角α"),
    "dip_dir": ("dip_direction", "dip direction", "dipdir", "dip dir", "dip_dir", "dip_dir_deg", "azimuth", "trend", "倾向", "倾向角", "倾向方位角", "方位", "方位角"),
    "well": ("well", "well_id", "borehole", "hole", "井号", "井名", "孔号", "钻孔", "钻孔编号"),
}

#: Aliases that stand for a column only as they are: a header `id` is no part of `well_id`.
EXACT = ("well_id",)
#: Columns that a log can't do without.
NEEDED = ("depth", "dip", "dip_dir")


def plain(name: str) -> str:
    """A header without case, brackets, units' signs and outer spaces."""
    out = name.strip().lower().replace("﻿", "")
    for opening, closing in (("(", ")"), ("[", "]"), ("（", "）")):
        while opening in out and closing in out[out.index(opening) :]:
            a = out.index(opening)
            out = out[:a] + out[out.index(closing, a) + 1 :]
    return out.replace("°", "").strip()


def find_columns(names: list[str]) -> dict[str, str]:
    """Which header stands for which column: an exact alias first, else one that holds the other, of two letters or more."""
    found: dict[str, str] = {}
    for exact in (True, False):
        for want, aliases in ALIASES.items():
            for name in names:
                p = plain(name)
                hit = p in aliases if exact else len(p) >= 2 and any(len(a) >= 2 and (a in p or p in a) for a in aliases if a not in EXACT)
                if want not in found and name not in found.values() and hit:
                    found[want] = name
    return found


def number(x: Column) -> Column:
    """A finite number, or null."""
    v = x.cast("string").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _log_cells(spark: SparkSession, path: str | list[str], encoding: str | None) -> DataFrame:
    """(file, well, row_id, depth, dip, dip_dir) of log files, cells as they stand there."""
    cells = cells_by_header(spark, path, find_columns, ("well", *NEEDED), NEEDED, encoding)
    stem = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1)
    named = F.when(F.trim("well") != "", F.trim("well"))
    return cells.select(F.col("name").alias("file"), F.coalesce(named, stem).alias("well"), "row_id", *NEEDED)


def read_log(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """(well, row_id, depth, dip, dip_dir) of one CSV or a folder of them; what is no number is null.

    Every file is read by its own header, so files of a folder may order or name their columns differently; one
    without a depth, dip or dip direction column is an error. Without a well column, or a name in it, the file's
    name is the well's. row_id is the row's place in its file: 0 is the line after the header. Files are UTF-8, or
    else GB18030, each by itself, unless an encoding is given.
    """
    return _log_cells(spark, path, encoding).select("well", "row_id", *(number(F.col(c)).alias(c) for c in NEEDED))


def skipped_lines(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """(file, well, line, column, reason) of each row of read_log() that has a null: its line, the header's being 1.

    column is the first that is to blame, reason `missing`, `not a number` or `not finite`.
    """
    cells = _log_cells(spark, path, encoding)
    first = F.lit(None).cast("struct<column:string,reason:string>")
    for c in reversed(NEEDED):
        reason = F.when(F.coalesce(F.trim(c), F.lit("")) == "", "missing").when(F.col(c).try_cast("double").isNull(), "not a number").otherwise("not finite")
        first = F.when(number(F.col(c)).isNull(), F.struct(F.lit(c).alias("column"), reason.alias("reason"))).otherwise(first)
    told = cells.withColumn("fault", first).filter("fault is not null")
    return told.select("file", "well", (F.col("row_id") + 2).alias("line"), "fault.column", "fault.reason")


def by_depth(log: DataFrame) -> DataFrame:
    """The good rows of read_log() with `place`, from 0, by depth in each well; equal depths keep the file's order.

    A well's rows are ordered in one task, as its trajectory and gaps are.
    """
    good = log.dropna(subset=list(NEEDED))
    return good.withColumn("place", F.row_number().over(Window.partitionBy("well").orderBy("depth", "row_id")) - 1)


def skipped_rows(log: DataFrame) -> DataFrame:
    """(well, n_rows, n_skipped) of read_log(): rows without a depth, dip or dip direction are skipped. Wells without any good row fail when read."""
    bad = F.col("depth").isNull() | F.col("dip").isNull() | F.col("dip_dir").isNull()
    counts = log.groupBy("well").agg(F.count("*").alias("n_rows"), F.count(F.when(bad, 1)).alias("n_skipped"))
    message = F.concat(F.lit("no row of well "), F.col("well"), F.lit(" can be read"))
    return counts.withColumn("n_skipped", F.when(F.col("n_skipped") == F.col("n_rows"), F.raise_error(message).cast("long")).otherwise(F.col("n_skipped")))


def read_picks(spark: SparkSession, path: str, window: tuple[float, float] | None = None, well: str = "picks") -> DataFrame:
    """Picks (md_ft, dip_deg, dip_dir_deg) of a second source in the log's shape, depth in metres, within a closed window of feet."""
    columns = ("md_ft", "dip_deg", "dip_dir_deg")
    raw = cells_by_header(spark, path, lambda names: {c: c for c in columns if c in names}, columns, columns)
    rows = raw.select(F.lit(well).alias("well"), "row_id", number(F.col("md_ft")).alias("ft"), number(F.col("dip_deg")).alias("dip"), number(F.col("dip_dir_deg")).alias("dip_dir"))
    rows = rows.dropna(subset=["ft", "dip", "dip_dir"])
    if window:
        rows = rows.filter(F.col("ft").between(*window))
    return rows.select("well", "row_id", (F.col("ft") * 0.3048).alias("depth"), "dip", "dip_dir")


def with_normals(log: DataFrame) -> DataFrame:
    return log.withColumns(dict(zip(("nx", "ny", "nz"), angles.normal(F.col("dip"), F.col("dip_dir")))))


def normals_to_log(rows: DataFrame) -> DataFrame:
    """(well, row_id, depth, nx, ny, nz, dip, dip_dir) from (well, normals array of arrays); zero rows are padding.

    Depth runs evenly from 0 to 100 over a well's entries.
    """
    each = rows.select("well", F.size("normals").alias("n"), F.posexplode("normals").alias("row_id", "v"))
    out = each.select("well", F.col("row_id").cast("long").alias("row_id"), (F.lit(100.0) * F.col("row_id") / F.greatest(F.col("n") - 1, F.lit(1))).alias("depth"), *(F.get("v", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("nx", "ny", "nz"))))
    n = angles.vector()
    kept = out.filter(angles.length(n) > 0.5)
    return kept.withColumn("dip", angles.dip(n)).withColumn("dip_dir", angles.dip_direction(n))


def read_traces(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(file, trace_id, px, py, pz, strike, nx, ny, nz, set_id) of the LineStrings of GeoJSON files.

    A trace lies at the mean of its vertices, as a vertical plane along its first and last one. Files with
    fewer traces than `least` are left out.
    """
    schema = "features array<struct<geometry:struct<type:string,coordinates:array<array<double>>>,properties:struct<Id:long>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    f = raw.select(F.col("_metadata.file_name").alias("file"), F.posexplode("features").alias("i", "f")).filter("f.geometry.type = 'LineString'")
    c = F.col("f.geometry.coordinates")
    mean = lambda i: F.aggregate(c, F.lit(0.0), lambda s, p: s + p[i]) / F.size(c)
    first, last = c[0], F.element_at(c, -1)
    rows = f.select("file", F.coalesce("f.properties.Id", F.col("i").cast("long")).alias("trace_id"), mean(0).alias("px"), mean(1).alias("py"), F.lit(0.0).alias("pz"), angles.trace_strike(first[0], first[1], last[0], last[1]).alias("strike"))
    enough = rows.groupBy("file").count().filter(F.col("count") >= least)
    rows = rows.join(enough, "file", "left_semi")
    return rows.withColumns(dict(zip(("nx", "ny", "nz"), angles.vertical_normal(F.col("strike"))))).withColumn("set_id", angles.trace_set(F.col("strike")))


def fracture_ids(traces: DataFrame) -> DataFrame:
    """traces with fracture_id, from 0 in the order of file and trace: every trace is a fracture of its own.

    Ids run on over the files: each file's begin behind all before it, so only counts by file are ordered in one task.
    """
    counts = traces.groupBy("file").agg(F.count("*").alias("n"))
    before = counts.select("file", (F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("trace_id", "px", "py"))
    return traces.withColumn("__rank", rank).join(before, "file").withColumn("fracture_id", (F.col("before") + F.col("__rank") - 1).cast("long")).drop("__rank", "before")


def type_group(raw: Column) -> Column:
    """Natural or induced; null for beds and faults, which are no fractures."""
    t = F.lower(raw)
    return F.when(t.contains("bed") | t.contains("fault"), F.lit(None).cast("string")).when(t.contains("tensile"), "induced").otherwise("natural")


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_id, md, azimuth, dip, hazi, hdev, ftype) from the ~CURVE and ~ASCII sections of LAS files.

    Columns are found by their mnemonics, whatever the case: MD or else TDEP, Azimuth, Dip, HAzi, HDev, Type. A
    missing HAzi or HDev is 0; rows whose depth, azimuth or dip is no number are left out. Each file's lines are
    read in order by one task, as the format has no other place to start; files spread over the cluster.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    marked = files.withColumn("lines", lines)
    head = F.transform(F.filter("lines", lambda x: x.startswith("~")), lambda x: F.upper(F.substring(x, 1, 2)))
    at = lambda c: F.array_position(F.transform("lines", lambda x: F.upper(F.substring(x, 1, 2))), F.lit(c)).cast("int")
    marked = marked.withColumn("__head", head).withColumn("__c", at("~C")).withColumn("__a", at("~A"))
    after = F.filter(F.sequence(F.col("__c") + 1, F.size("lines")), lambda i: F.substring(F.get(F.col("lines"), i - 1), 1, 1) == "~")
    end = F.coalesce(F.array_min(after), F.size("lines") + 1)
    names = F.transform(F.slice("lines", F.col("__c") + 1, F.greatest(end - F.col("__c") - 1, F.lit(0))), lambda x: F.upper(F.regexp_extract(x, r"^\s*([^\s.]+)", 1)))
    table = marked.filter("__c > 0 AND __a > 0").withColumn("names", names).select("file", "names", F.posexplode(F.slice("lines", F.col("__a") + 1, F.size("lines"))).alias("row_id", "line"))
    cells = table.withColumn("v", F.regexp_extract_all("line", F.lit(r'("[^"]*"|\S+)'), F.lit(1)))

    def holds(key: str):
        return lambda n: F.contains(n, F.lit(key))

    def column(*keys: str) -> Column:
        out = F.lit(None).cast("string")
        for key in reversed(keys):
            i = F.array_position(F.transform("names", holds(key)), True).cast("int")
            out = F.coalesce(F.when(i > 0, F.get("v", i - 1)), out)
        return out

    rows = cells.select(
        "file", F.col("row_id").cast("long").alias("row_id"), number(column("MD", "TDEP")).alias("md"), number(column("AZIMUTH")).alias("azimuth"), number(column("DIP_TRU", "DIP")).alias("dip"),
        F.coalesce(number(column("HAZI")), F.lit(0.0)).alias("hazi"), F.coalesce(number(column("HDEV")), F.lit(0.0)).alias("hdev"), type_group(F.trim(F.regexp_replace(F.coalesce(column("TYPE"), F.lit("")), '"', ""))).alias("ftype"),
    )
    return rows.dropna(subset=["md", "azimuth", "dip", "ftype"])


def read_network_dir(spark: SparkSession, path: str) -> DataFrame:
    """(net, id, px, py, pz, nx, ny, nz, radius) of a folder with normal_vectors.dat, translations.dat and radii_Final.dat.

    The files share their order of lines: line i of each belongs to fracture i.
    """

    def lines(name: str, columns: list[str], skip: str = "^[A-Za-z]") -> DataFrame:
        text = spark.read.text(f"{path}/{name}", wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.rlike(skip)).alias("l"))
        each = text.select(F.posexplode("l").alias("id", "line")).withColumn("v", F.split(F.trim("line"), r"\s+"))
        return each.select("id", *(F.get("v", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(columns)))

    n = lines("normal_vectors.dat", ["nx", "ny", "nz"])
    p = lines("translations.dat", ["px", "py", "pz"])
    radii = lines("radii_Final.dat", ["radius", "radius2"])
    return n.join(p, "id").join(radii, "id").select(F.lit(path).alias("net"), F.col("id").cast("long").alias("id"), "px", "py", "pz", "nx", "ny", "nz", F.greatest("radius", F.coalesce("radius2", "radius")).alias("radius"))


def polygon(line: Column) -> Column:
    """Array of struct(x, y, z) of a line `n {x, y, z} {x, y, z} ...`; null if it doesn't have n of them."""
    listed = F.regexp_extract_all(line, F.lit(r"\{([^}]*)\}"), F.lit(1))
    points = F.transform(listed, lambda s: F.transform(F.split(s, ","), lambda v: F.trim(v).try_cast("double")))
    count = F.regexp_extract(line, r"^\s*(\d+)", 1).try_cast("int")
    return F.when(F.size(points) == count, F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"), p[2].alias("z"))))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Logs of several sources as one table with source_type; columns that one lacks are null there."""
    out = None
    for name, rows in sources.items():
        tagged = rows.withColumn("source_type", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source")
    return out


def observed_subset(rows: DataFrame, per_fracture: int, seed: int = 0) -> DataFrame:
    """rows with is_obs: per_fracture rows of each fracture at most, by a hash."""
    w = Window.partitionBy("net", "fracture_id").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    return rows.withColumn("is_obs", F.row_number().over(w) <= per_fracture)
