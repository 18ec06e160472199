"""Queries of estimated sets, surveys and evidence, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles
from ..operators import evidence, outcrop, predict, surveys
from . import views as v
from .intrinsic import _CLOUD, _SEGMENTS, _cloud
from .registry import _KNN, _MATCHED, _MU, _SET_AWARE, query, r, rounded

_NEAREST = "row_number() OVER (PARTITION BY net, id ORDER BY abs(nx*cx+ny*cy+nz*cz) DESC, c.set_id)"


# sets estimated by nets


def _estimated(name: str, seen: str) -> str:
    """CTEs <name>m: each net's sets from the rows that `seen` names; <name>p: all rows at the nearest of them. v.POINTS and v.CENTERS come before."""
    return (
        f"{name}a AS (SELECT *, CASE WHEN nx*cx+ny*cy+nz*cz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g FROM (SELECT p.net, p.id, nx, ny, nz, c.set_id, cx, cy, cz, {_NEAREST} AS o FROM pts p, centers c WHERE {seen}) WHERE o = 1), "
        f"{name}m AS (SELECT net, set_id, x/sqrt(x*x+y*y+z*z) AS mx, y/sqrt(x*x+y*y+z*z) AS my, z/sqrt(x*x+y*y+z*z) AS mz FROM (SELECT net, set_id, sum(nx*g) AS x, sum(ny*g) AS y, sum(nz*g) AS z FROM {name}a GROUP BY ALL)), "
        f"{name}p AS (SELECT * FROM (SELECT p.net, p.id, m.set_id, least(1.0::DOUBLE, abs(nx*mx+ny*my+nz*mz)) AS cos, row_number() OVER (PARTITION BY p.net, p.id ORDER BY abs(nx*mx+ny*my+nz*mz) DESC, m.set_id) AS o FROM pts p JOIN {name}m m USING (net)) WHERE o = 1)"
    )


@query(
    f"WITH {v.POINTS}, {v.CENTERS}, {_estimated('e', 'is_obs')}, s AS (SELECT net, set_id, count(*) AS n_points, degrees(acos(least(1.0::DOUBLE, avg(cos)))) AS dispersion, degrees(acos(min(cos))) AS max_deviation FROM ep GROUP BY ALL) "
    f"SELECT net, set_id, n_points, {r('mx', 'mx')}, {r('my', 'my')}, {r('mz', 'mz')}, {r('dispersion', 'dispersion', 3)}, {r('max_deviation', 'max_deviation', 3)}, n_points >= 3 AS statistical FROM em JOIN s USING (net, set_id)"
)
def set_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of every net from its observed rows, and how far all its rows lie from them."""
    table, placed = surveys.estimated_sets(v.points(spark, sf_dir), v.reference_centers())
    spread = surveys.set_spread(placed).select("net", "set_id", *(F.round(c, 3).alias(c) for c in ("dispersion", "max_deviation")), "statistical")
    return rounded(table).join(spread, ["net", "set_id"])


@query(
    f"WITH {v.POINTS}, {v.CENTERS}, {_estimated('e', 'is_obs')}, {_estimated('f', 'TRUE')}, tables AS (SELECT 2 * net AS well, set_id, mx, my, mz FROM em UNION ALL SELECT 2 * net + 1, set_id, mx, my, mz FROM fm), {_MATCHED}, "
    "sc AS (SELECT a // 2 AS net, count(*) AS n_matched, avg(angle) AS modal_error, count(*) FILTER (angle < 30) AS n_success FROM mat WHERE a % 2 = 0 AND b = a + 1 GROUP BY ALL), "
    "ks AS (SELECT well // 2 AS net, count(*) FILTER (well % 2 = 0) AS k_pred, count(*) FILTER (well % 2 = 1) AS k_true FROM tables GROUP BY ALL), "
    "l AS (SELECT net, e.set_id AS a, f.set_id AS b FROM ep e JOIN fp f USING (net, id)), g AS (SELECT net, grouping(a, b) AS g, count(*) AS n FROM l GROUP BY GROUPING SETS ((net, a, b), (net, a), (net, b), (net))), "
    "s AS (SELECT net, sum(CASE WHEN g = 0 THEN n * (n - 1) / 2 ELSE 0 END) AS ab, sum(CASE WHEN g = 1 THEN n * (n - 1) / 2 ELSE 0 END) AS sa, sum(CASE WHEN g = 2 THEN n * (n - 1) / 2 ELSE 0 END) AS sb, sum(CASE WHEN g = 3 THEN n * (n - 1) / 2 ELSE 0 END) AS t FROM g GROUP BY net) "
    f"SELECT net, k_pred, k_true, abs(k_pred - k_true) AS k_diff, {r('coalesce(modal_error, 90)', 'modal_error', 3)}, {r('coalesce(n_success, 0) / greatest(k_true, 1)', 'coverage')}, coalesce(n_matched, 0) AS n_matched, coalesce(n_success, 0) AS n_success, {r('(ab - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t)', 'ari')} FROM ks LEFT JOIN sc USING (net) JOIN s USING (net)"
)
def set_table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets from observed rows against those from all rows, and how far the two place the rows alike."""
    rows = v.points(spark, sf_dir)
    table, placed = surveys.estimated_sets(rows, v.reference_centers())
    truth, right = surveys.estimated_sets(rows, v.reference_centers(), observed_only=False)
    labels = placed.select("net", "id", F.col("set_id").alias("predicted")).join(right.select("net", "id", F.col("set_id").alias("true")), ["net", "id"])
    return rounded(surveys.table_scores(table, truth, labels).withColumn("modal_error", F.round("modal_error", 3)))


@query(
    f"WITH {_SET_AWARE}, c AS (SELECT net, set_id, count(*) FILTER (is_obs) AS n_obs FROM pts GROUP BY ALL), d AS (SELECT c.net, c.set_id, n_obs, coalesce(x, gx) AS x, coalesce(y, gy) AS y, coalesce(z, gz) AS z, x IS NULL AS borrowed FROM c JOIN t USING (net) LEFT JOIN s ON s.net = c.net AND s.set_id = c.set_id) "
    f"SELECT net, set_id, n_obs, {r('x / sqrt(x*x+y*y+z*z)', 'mx')}, {r('y / sqrt(x*x+y*y+z*z)', 'my')}, {r('z / sqrt(x*x+y*y+z*z)', 'mz')}, borrowed FROM d"
)
def set_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(surveys.set_directions(v.points(spark, sf_dir)))


@query(
    f"WITH {_KNN}, {_MU}, j AS (SELECT r.net, r.id, qx, qy, qz, ux, uy, uz, CASE WHEN ux*qx+uy*qy+uz*qz < 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS g FROM ranked r JOIN asg a ON a.net = r.net AND a.id = r.other AND a.k = 1 JOIN mu ON mu.net = r.net AND mu.set_id = a.set_id WHERE rank = 1), "
    "b AS (SELECT net, id, qx + g*ux AS x, qy + g*uy AS y, qz + g*uz AS z FROM j) "
    f"SELECT net, id, {r('x / sqrt(x*x+y*y+z*z)', 'qx')}, {r('y / sqrt(x*x+y*y+z*z)', 'qy')}, {r('z / sqrt(x*x+y*y+z*z)', 'qz')} FROM b"
)
def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predict.semantic(predict.blind(v.points(spark, sf_dir)), v.reference_centers(), k=len(v.REFERENCE)))


_FINE = "dip BETWEEN 0 AND 90 AND dip_dir < 360"


@query(
    f"WITH {v.RAW_LOG}, b AS (SELECT well, row_id, {_FINE} AS fine FROM raw_log) SELECT well AS net, count(*) AS n, count(*) FILTER (NOT fine) AS n_missing, 0::BIGINT AS n_infinite, 0::BIGINT AS n_zero, min(row_id) FILTER (NOT fine) AS first_bad, count(*) FILTER (NOT fine) = 0 AS usable FROM b GROUP BY well"
)
def net_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every well that have no normal, as their dip or direction is out of range."""
    n = angles.normal(F.col("dip"), F.col("dip_dir"))
    rows = v.raw_log(spark, sf_dir).withColumns({f"n{c}": F.when(F.expr(_FINE), x) for x, c in zip(n, "xyz")})
    return surveys.net_checks(rows.select(F.col("well").alias("net"), F.col("row_id").alias("id"), "nx", "ny", "nz"))


# surveys


def _survey_sql(route: str, observed: str) -> str:
    """One survey: rows observed by an expression, their sets those of the nearest centers."""
    cut = "tt AS (SELECT *, px * cos(radians(30)) + py * sin(radians(30)) AS t FROM pts0), ct AS (SELECT net, quantile_cont(t, 0.6) AS cut FROM tt GROUP BY net)"
    points = (
        f"{v.POINTS.replace('pts AS', 'pts0 AS')}, {v.CENTERS}, {cut}, pts AS (SELECT * FROM (SELECT p.* EXCLUDE (set_id, is_obs, t), {observed} AS is_obs, c.set_id, row_number() OVER (PARTITION BY p.net, p.id ORDER BY abs(nx*cx+ny*cy+nz*cz) DESC, c.set_id) AS o FROM tt p JOIN ct USING (net), centers c) WHERE o = 1)"
    )
    return (
        f"(WITH {_SET_AWARE.replace(v.POINTS, points)}, er AS (SELECT a.net, degrees(acos(least(1.0::DOUBLE, abs(nx*x + ny*y + nz*z) / sqrt(x*x+y*y+z*z)))) AS error FROM a JOIN pts USING (net, id)) "
        f"SELECT '{route}' AS route, net, {len(v.REFERENCE)} AS k, count(*) AS n, {r('avg(error)', 'mae', 3)}, {r('quantile_cont(error, 0.5)', 'p50', 3)}, {r('quantile_cont(error, 0.9)', 'p90', 3)} FROM er GROUP BY net)"
    )


@query(f"{_survey_sql('full', 'is_obs')} UNION ALL {_survey_sql('block', 't >= cut')}")
def survey_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of hidden rows of every net where all of it, and where a block of it, was surveyed; sets around given centers."""
    rows = v.points(spark, sf_dir)
    full = surveys.full_survey(rows, v.reference_centers()).withColumn("route", F.lit("full"))
    block = surveys.block_survey(rows, centers=v.reference_centers()).withColumn("route", F.lit("block"))
    return rounded(full.unionByName(block), 3)


@query()
def block_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors where a block was surveyed and the number of sets is chosen from what was observed there."""
    return rounded(surveys.block_survey(v.points(spark, sf_dir), most=4), 3)


# evidence

_KIND = "CASE set_id WHEN 0 THEN 'joint' WHEN 1 THEN 'fault' WHEN 2 THEN 'vein' WHEN 3 THEN 'bedding' END"
_NAMED = f"CASE WHEN {_KIND} IS NULL THEN net::VARCHAR ELSE net::VARCHAR || '_' || {_KIND} END"
_BUNDLE = (
    f"{v.LOG}, {v.POINTS}, {v.STATIONS}, {_CLOUD}, {_SEGMENTS}, "
    "bundle AS (SELECT 'L0' AS source_type, well::VARCHAR AS source_name, 'normal_obs' AS data_type, 'unknown' AS structure_type, nx, ny, nz, NULL::DOUBLE AS strike, NULL::DOUBLE AS area FROM obs "
    f"UNION ALL SELECT 'L1', {_NAMED}, 'normal_obs', CASE WHEN set_id IN (0, 1, 3) THEN {_KIND} ELSE 'unknown' END, nx, ny, nz, NULL, NULL FROM pts "
    "UNION ALL SELECT 'L2', well::VARCHAR, 'strike_constraint', 'unknown', NULL, NULL, NULL, hazi % 180, NULL FROM st "
    "UNION ALL SELECT 'L3', 'outcrop_' || net || '_s' || seg_id, 'normal_obs', 'unknown', nx, ny, nz, NULL, area FROM sf)"
)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs, imaging logs by kind of structure, traces and outcrop surfaces of the given tables."""
    kind = F.when(F.col("set_id") == 0, "joint").when(F.col("set_id") == 1, "fault").when(F.col("set_id") == 2, "vein").when(F.col("set_id") == 3, "bedding")
    return evidence.bundle(
        evidence.normals(v.log(spark, sf_dir), "L0", F.col("well")),
        evidence.typed_normals(v.points(spark, sf_dir), "L1", F.col("net"), kind),
        evidence.strikes(v.stations(spark, sf_dir), F.col("well"), F.col("hazi")),
        evidence.surfaces(outcrop.surfaces(_cloud(spark, sf_dir))),
    )


@query(f"WITH {_BUNDLE} SELECT source_type, source_name, data_type, structure_type, 1.0::DOUBLE AS weight, count(*) AS n_obs, data_type = 'strike_constraint' AS constraint_only FROM bundle GROUP BY ALL")
def evidence_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.entries(_evidence(spark, sf_dir))


@query(
    f"WITH {_BUNDLE} SELECT source_type, structure_type, count(*) AS n, {r('avg(abs(nz))', 'mean_nz')}, {r('max(abs(nx*nx + ny*ny + nz*nz - 1))', 'off_unit')}, {r('coalesce(sum(area), 0)', 'area', 0)} FROM bundle WHERE data_type = 'normal_obs' GROUP BY ALL"
)
def evidence_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be averaged, by source and kind of structure."""
    n = angles.vector()
    told = evidence.observed_normals(_evidence(spark, sf_dir)).groupBy("source_type", "structure_type").agg(
        F.count("*").alias("n"), F.avg(F.abs("nz")).alias("mean_nz"), F.max(F.abs(angles.dot(n, n) - 1)).alias("off_unit"), F.coalesce(F.sum(F.try_element_at("meta", F.lit("area"))), F.lit(0.0)).alias("area")
    )
    return rounded(told.withColumn("area", F.round("area", 0)))


@query(
    "WITH pc AS (SELECT l_returnflag AS net, l_orderkey * 10 + l_linenumber AS id, l_linenumber + 3 AS seg_id, radians(((l_quantity * 7 + l_partkey) % 91)::DOUBLE) AS d, radians(((l_orderkey * 37 + l_linenumber * 11) % 360)::DOUBLE) AS a FROM lineitem), "
    "p AS (SELECT net, id, seg_id, sin(d) * sin(a) AS nx, sin(d) * cos(a) AS ny, cos(d) AS nz FROM pc), f AS (SELECT net, seg_id, arg_min(nx, id) AS rx, arg_min(ny, id) AS ry, arg_min(nz, id) AS rz FROM p GROUP BY ALL), "
    "s AS (SELECT net, seg_id, count(*) AS n_points, avg(nx*g) AS x, avg(ny*g) AS y, avg(nz*g) AS z FROM (SELECT p.*, CASE WHEN nx*rx+ny*ry+nz*rz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g FROM p JOIN f USING (net, seg_id)) GROUP BY ALL) "
    f"SELECT 'point_cloud_' || net || '_s' || (row_number() OVER (PARTITION BY net ORDER BY seg_id) - 1) AS source_name, n_points::DOUBLE AS n_points, {r('x / sqrt(x*x+y*y+z*z)', 'nx')}, {r('y / sqrt(x*x+y*y+z*z)', 'ny')}, {r('z / sqrt(x*x+y*y+z*z)', 'nz')} FROM s"
)
def segment_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each segment of clouds that come with normals; of rows with one id the first in the table counts as the first."""
    lines = v.table(spark, sf_dir, "lineitem")
    place = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    n = angles.normal(F.pmod(F.col("l_quantity") * 7 + F.col("l_partkey"), F.lit(91)).cast("double"), F.pmod(F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11, F.lit(360)).cast("double"))
    points = lines.select(F.col("l_returnflag").alias("net"), place.alias("id"), (F.col("l_linenumber") + 3).alias("seg_id"), *(x.alias(f"n{c}") for x, c in zip(n, "xyz")))
    return rounded(evidence.segments(points).select("source_name", F.try_element_at("meta", F.lit("n_points")).alias("n_points"), "nx", "ny", "nz"))
