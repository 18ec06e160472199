"""Evidence of several sources as one table of observations: what is measured, by whom, and what may be averaged.

A row of a bundle is one observation: source_type (L0 logs, L1 imaging logs, L2 traces, L3 surfaces), source_name,
data_type, structure_type, weight, nx, ny, nz, strike, meta. An entry is the rows that share ENTRY. A bundle grows
with its sources and nothing of it is gathered; sums over entries come before any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles
from .tables import written

NORMALS, STRIKES = "normal_obs", "strike_constraint"
#: Kinds of structures, fixed values; all others are unknown.
STRUCTURES = ("joint", "bedding", "foliation", "fault", "induced", "natural", "contact", "unknown")
ENTRY = ("source_type", "source_name", "data_type", "structure_type")
_NO_META = "cast(map() as map<string,double>)"


def _known(structure: Column | None) -> Column:
    if structure is None:
        return F.lit("unknown")
    return F.when(structure.isin(*STRUCTURES), structure).otherwise(F.lit("unknown"))


def _observations(rows: DataFrame, source_type: str, name: Column, data_type: str, structure: Column | None, weight: float, parts: dict[str, Column], meta: Column | None = None) -> DataFrame:
    return rows.select(
        F.lit(source_type).alias("source_type"),
        name.cast("string").alias("source_name"),
        F.lit(data_type).alias("data_type"),
        _known(structure).alias("structure_type"),
        F.lit(float(weight)).alias("weight"),
        *(parts.get(c, F.lit(None).cast("double")).cast("double").alias(c) for c in ("nx", "ny", "nz", "strike")),
        (meta if meta is not None else F.expr(_NO_META)).alias("meta"),
    )


def normals(rows: DataFrame, source_type: str, name: Column, structure: Column | None = None, weight: float = 1.0) -> DataFrame:
    """Observations of measured normals (nx, ny, nz), made unit; a structure that is not in STRUCTURES is unknown.

    A normal with a null part or shorter than 1e-12 gives no observation. A null name stays null: an entry of its own.
    """
    n = angles.vector()
    fine = rows.filter(angles.length(n) > 1e-12)
    return _observations(fine, source_type, name, NORMALS, structure, weight, dict(zip(("nx", "ny", "nz"), angles.unit(n, 0.0))))


def typed_normals(rows: DataFrame, source_type: str, well: Column, structure: Column, weight: float = 1.0) -> DataFrame:
    """normals() with an entry for each kind of structure of a well, named well_kind; rows without a kind are the well's own entry, and those of a null well are one without a name for each kind."""
    name = F.when(structure.isNull(), well.cast("string")).otherwise(F.concat(well.cast("string"), F.lit("_"), structure))
    return normals(rows, source_type, name, structure, weight)


def strikes(rows: DataFrame, name: Column, strike: Column, weight: float = 1.0) -> DataFrame:
    """Constraints of traces: strikes in degrees, 0 to 180. They have no normals and are never averaged; a null strike gives none."""
    told = rows.withColumn("__strike", angles.wrap(strike, 180)).filter("__strike IS NOT NULL")
    return _observations(told, "L2", name, STRIKES, None, weight, {"strike": F.col("__strike")})


def surfaces(found: DataFrame, prefix: str = "outcrop", weight: float = 1.0) -> DataFrame:
    """An entry of one normal for each surface of outcrop.surfaces(); its number, set, points, area, radius and residual are its meta."""
    name = F.concat_ws("_", F.lit(prefix), F.col("net").cast("string"), F.concat(F.lit("s"), F.col("seg_id").cast("string")))
    told = F.create_map(*(x for c in ("seg_id", "set_id", "n_points", "area", "r_eq", "rms") for x in (F.lit(c), F.col(c).cast("double"))))
    return _observations(found, "L3", name, NORMALS, None, weight, dict(zip(("nx", "ny", "nz"), angles.unit(angles.vector(), 0.0))), told)


def segments(points: DataFrame, prefix: str = "point_cloud", weight: float = 1.0) -> DataFrame:
    """An entry for each segment of clouds (net, id, nx, ny, nz, seg_id): the mean of its normals on the side of its first by id.

    id may be of any type that has an order; of rows with one id the one of least nx, ny, nz is the first. Segments are numbered from 0 in each cloud by seg_id. A negative or null seg_id is none. A segment whose normals
    cancel out has no entry, but keeps its number.
    """
    own = points.filter((F.col("seg_id") >= 0) & (angles.length(angles.vector()) > 1e-12)).select("net", "id", "seg_id", "nx", "ny", "nz")
    first = own.groupBy("net", "seg_id").agg(F.min_by(F.struct("nx", "ny", "nz"), F.struct("id", "nx", "ny", "nz")).alias("r"))
    side = angles.aligned(angles.vector(), tuple(F.col("r")[f"n{c}"] for c in "xyz"))
    sums = own.join(first, ["net", "seg_id"]).groupBy("net", "seg_id").agg(F.count("*").alias("n_points"), *(F.avg(s).alias(k) for s, k in zip(side, ("nx", "ny", "nz"))))
    numbered = sums.withColumn("__i", F.row_number().over(Window.partitionBy("net").orderBy("seg_id")) - 1).filter(angles.length(angles.vector()) > 1e-12)
    name = F.concat_ws("_", F.lit(prefix), F.col("net").cast("string"), F.concat(F.lit("s"), F.col("__i").cast("string")))
    told = F.create_map(*(x for c in ("seg_id", "n_points") for x in (F.lit(c), F.col(c).cast("double"))))
    return _observations(numbered, "L3", name, NORMALS, None, weight, dict(zip(("nx", "ny", "nz"), angles.unit(angles.vector(), 0.0))), told)


def bundle(*sources: DataFrame) -> DataFrame:
    """All observations of the sources, one or more."""
    return reduce(DataFrame.unionByName, sources)


def entries(evidence: DataFrame) -> DataFrame:
    """(ENTRY, weight, n_obs, constraint_only): one row for each entry of a bundle."""
    return evidence.groupBy(*ENTRY).agg(F.max("weight").alias("weight"), F.count("*").alias("n_obs")).withColumn("constraint_only", F.col("data_type") == STRIKES)


def observed_normals(evidence: DataFrame) -> DataFrame:
    """The observations that may be averaged: those of normals, constraints left out."""
    return evidence.filter((F.col("data_type") == NORMALS) & F.col("nx").isNotNull())


def resolved(wanted: DataFrame, tables: DataFrame) -> DataFrame:
    """wanted (source_type, idx) with `table`, the idx of the table that is meant; tables has source_type and idx.

    A table at that very place and of that type is meant; failing that, the only table of the type, if there is just
    one. A type of several tables fails when it is read, as the wrong one could be taken; a type of none gives null.
    """
    places = written(tables.select("source_type", "idx"), "evidence-tables")
    exact = places.select("source_type", "idx", F.col("idx").alias("__at"))
    types = places.groupBy("source_type").agg(F.count("*").alias("__n"), F.min("idx").alias("__only"))
    met = wanted.join(exact, ["source_type", "idx"], "left").join(types, "source_type", "left")
    several = F.raise_error(F.format_string("%s tables are of type %s and none is named by its place", F.col("__n"), F.col("source_type")))
    table = F.when(F.col("__at").isNotNull(), F.col("__at")).when(F.col("__n") == 1, F.col("__only")).when(F.col("__n") > 1, several.cast("bigint"))
    return met.withColumn("table", table).drop("__at", "__n", "__only")


def consistency_counts(reconciled: DataFrame) -> DataFrame:
    """One row: n_green, n_yellow, n_red, n_fused, n_unified and n_arbitration of fusion.reconcile()'s rows; zeros where there are none."""
    of = lambda light: F.count(F.when(F.col("light") == light, 1)).alias(f"n_{light}")
    single = F.col("set_a").isNull() | F.col("set_b").isNull()
    return reconciled.agg(
        of("green"), of("yellow"), of("red"),
        F.count(F.when(F.col("outcome") == "fused", 1)).alias("n_fused"),
        F.count(F.when((F.col("outcome") == "fused") | single, 1)).alias("n_unified"),
        F.count(F.when((F.col("light") == "red") & ~single, 1)).alias("n_arbitration"),
    )
