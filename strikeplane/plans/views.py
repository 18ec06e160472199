"""Orientation data made from the given tables, by the same arithmetic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles

#: Centers (dip, dip direction) that sets are looked for around, in degrees.
REFERENCE = ((60.0, 30.0), (45.0, 150.0), (70.0, 280.0), (15.0, 90.0))


def reference_centers() -> list[tuple[float, float, float]]:
    import math

    out = []
    for dip, direction in REFERENCE:
        d, a = math.radians(dip), math.radians(direction)
        out.append((math.sin(d) * math.sin(a), math.sin(d) * math.cos(a), math.cos(d)))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of each supplier: well, row_id, depth, dip, dip_dir, ftype; some dips and directions are out of range."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("well"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        (F.col("l_extendedprice") / 100).alias("depth"),
        (F.pmod(F.col("l_quantity") * 7 + F.col("l_partkey"), F.lit(96.0)) - 3).alias("dip"),
        F.pmod(F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11, F.lit(364)).cast("double").alias("dip_dir"),
        F.col("l_returnflag").alias("ftype"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's rows with dip in 0..90 and dip direction below 360, and their normals."""
    ok = raw_log(spark, sf_dir).filter(F.col("dip").between(0, 90) & (F.col("dip_dir") < 360))
    n = angles.normal(F.col("dip"), F.col("dip_dir"))
    return ok.withColumns(dict(zip(("nx", "ny", "nz"), n)))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with normals from the embeddings: net, id, px.., nx.., is_obs, set_id, fracture_id."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda i: F.col("embedding")[i].cast("double")
    size = F.sqrt(part(0) * part(0) + part(1) * part(1) + part(2) * part(2))
    return e.select(
        F.col("label").alias("net"), F.col("vec_id").alias("id"),
        part(3).alias("px"), part(4).alias("py"), part(5).alias("pz"),
        (part(0) / size).alias("nx"), (part(1) / size).alias("ny"), (part(2) / size).alias("nz"),
        (F.pmod(F.col("vec_id") * 7919, F.lit(10)) < 4).alias("is_obs"),
        F.pmod(F.col("vec_id"), F.lit(5)).cast("int").alias("set_id"),
        F.pmod(F.floor(F.col("vec_id") / 7), F.lit(40)).alias("fracture_id"),
    )


def discs(spark: SparkSession, sf_dir: str, box: float = 100.0) -> DataFrame:
    """Discs from the parts: a net for each brand, centers from the key, radius from the size."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    at = lambda m: F.pmod(k * m, F.lit(10007)).cast("double") * (box / 10007)
    n = angles.normal(F.pmod(k * 13, F.lit(90)).cast("double"), F.pmod(k * 29, F.lit(360)).cast("double"))
    return p.select(
        F.col("p_brand").alias("net"), k.alias("id"), at(7919).alias("px"), at(104729).alias("py"), at(1299709).alias("pz"),
        *(x.alias(c) for x, c in zip(n, ("nx", "ny", "nz"))), (F.col("p_size") / 5.0 + 1).alias("radius"),
    )


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on tilted sheets from the line items: a net for each return flag, a sheet for each line number, a little off it by the quantity."""
    at = lambda m: F.pmod(F.col("l_orderkey") * m + F.col("l_partkey"), F.lit(10007)) / 100.0
    x, y = at(7919), at(104729)
    z = F.col("l_linenumber") * 20 + x * 0.3 - y * 0.2 + (F.col("l_quantity") - 25) / 500
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("net"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        x.alias("px"), y.alias("py"), z.cast("double").alias("pz"), F.col("l_linenumber").cast("int").alias("sheet"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey stations from the events of each user: md by order, azimuth and deviation from the event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("well"), F.col("event_id").alias("row_id"), F.col("event_id").cast("double").alias("md"),
        F.pmod(F.col("event_id") * 17, F.lit(360)).cast("double").alias("hazi"), F.pmod(F.col("event_id") * 3, F.lit(60)).cast("double").alias("hdev"),
    )


# The same in DuckDB SQL.
RAW_LOG = """raw_log AS (SELECT l_suppkey AS well, l_orderkey * 10 + l_linenumber AS row_id, l_extendedprice / 100 AS depth,
  (l_quantity * 7 + l_partkey) % 96.0::DOUBLE - 3 AS dip, ((l_orderkey * 37 + l_linenumber * 11) % 364)::DOUBLE AS dip_dir, l_returnflag AS ftype FROM lineitem)"""
LOG = (
    RAW_LOG
    + """, obs AS (SELECT *, sin(radians(dip)) * sin(radians(dip_dir)) AS nx, sin(radians(dip)) * cos(radians(dip_dir)) AS ny, cos(radians(dip)) AS nz, row_number() OVER () AS rid
  FROM raw_log WHERE dip BETWEEN 0 AND 90 AND dip_dir < 360)"""
)
POINTS = """e AS (SELECT label AS net, vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS px, embedding[5]::DOUBLE AS py, embedding[6]::DOUBLE AS pz FROM embeddings),
pts AS (SELECT net, id, px, py, pz, a / sqrt(a*a+b*b+c*c) AS nx, b / sqrt(a*a+b*b+c*c) AS ny, c / sqrt(a*a+b*b+c*c) AS nz, (id * 7919) % 10 < 4 AS is_obs, (id % 5)::INT AS set_id, (id // 7) % 40 AS fracture_id FROM e)"""
DISCS = """discs AS (SELECT p_brand AS net, p_partkey AS id, ((p_partkey * 7919) % 10007)::DOUBLE * (100.0::DOUBLE / 10007) AS px, ((p_partkey * 104729) % 10007)::DOUBLE * (100.0::DOUBLE / 10007) AS py,
  ((p_partkey * 1299709) % 10007)::DOUBLE * (100.0::DOUBLE / 10007) AS pz, p_size / 5.0::DOUBLE + 1 AS radius FROM part)"""
STATIONS = """st AS (SELECT user_id AS well, event_id AS row_id, event_id::DOUBLE AS md, ((event_id * 17) % 360)::DOUBLE AS hazi, ((event_id * 3) % 60)::DOUBLE AS hdev FROM events)"""
CENTERS = "centers AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, sin(radians({d})) * sin(radians({a})), sin(radians({d})) * cos(radians({a})), cos(radians({d})))" for k, (d, a) in enumerate(REFERENCE)) + ") t(set_id, cx, cy, cz))"
ASSIGNED = (
    LOG
    + ", "
    + CENTERS
    + """, sims AS (SELECT o.*, c.set_id, cx, cy, cz, abs(nx*cx + ny*cy + nz*cz) AS s, row_number() OVER (PARTITION BY rid ORDER BY abs(nx*cx + ny*cy + nz*cz) DESC, c.set_id) AS r FROM obs o, centers c),
assigned AS (SELECT *, degrees(acos(least(1.0::DOUBLE, s))) AS angle FROM sims WHERE r = 1)"""
)
MEANS = (
    ASSIGNED
    + """, sums AS (SELECT well, set_id, count(*) AS n, avg(nx * sg) AS sx, avg(ny * sg) AS sy, avg(nz * sg) AS sz FROM (SELECT *, CASE WHEN nx*cx + ny*cy + nz*cz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg FROM assigned) GROUP BY ALL),
means AS (SELECT well, set_id, n, sx / sqrt(sx*sx+sy*sy+sz*sz) AS mx, sy / sqrt(sx*sx+sy*sy+sz*sz) AS my, sz / sqrt(sx*sx+sy*sy+sz*sz) AS mz FROM sums),
spread AS (SELECT a.well, a.set_id, avg(degrees(acos(least(1.0::DOUBLE, abs(nx*mx + ny*my + nz*mz))))) AS mean_angle FROM assigned a JOIN means USING (well, set_id) GROUP BY ALL),
tables AS (SELECT m.*, mean_angle, n / sum(n) OVER (PARTITION BY well) AS proportion, least(100.0::DOUBLE, 1 / (radians(greatest(mean_angle, 1.0::DOUBLE)) * radians(greatest(mean_angle, 1.0::DOUBLE)) + 0.01::DOUBLE)) AS kappa,
  degrees(acos(least(1.0::DOUBLE, abs(mz)))) AS dip, ((degrees(atan2(mx, my)) + CASE WHEN mz < 0 THEN 180 ELSE 0 END) % 360 + 360) % 360 AS dip_dir FROM means m JOIN spread USING (well, set_id))"""
)
