"""Queries over the given tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles, grades
from ..operators import aggregates, clusters, fusion, neighbours, networks, ordered, planes, predict, quality, screening
from ..operators.tables import written
from . import views as v

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "set_table"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, zeros without a sign, for comparison."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(expr: str, name: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"


# scalar functions


@query(f"WITH {v.LOG} SELECT well, row_id, {r('nx', 'nx', 6)}, {r('ny', 'ny', 6)}, {r('nz', 'nz', 6)} FROM obs")
def normals_from_dip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(v.log(spark, sf_dir).select("well", "row_id", "nx", "ny", "nz"), 6)


@query(
    f"WITH {v.LOG}, back AS (SELECT well, degrees(acos(least(1.0::DOUBLE, abs(nz)))) AS d, ((degrees(atan2(nx, ny)) + CASE WHEN nz < 0 THEN 180 ELSE 0 END) % 360 + 360) % 360 AS a, dip, dip_dir FROM obs) "
    "SELECT well, count(*) AS n, count(*) FILTER (abs(d - dip) > 1e-5) AS n_dip_off, count(*) FILTER (dip > 0.5 AND dip < 89.5 AND least(abs(a - dip_dir), 360 - abs(a - dip_dir)) > 1e-5) AS n_direction_off FROM back GROUP BY well"
)
def roundtrip_dip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = angles.vector()
    rows = v.log(spark, sf_dir).withColumn("d", angles.dip(n)).withColumn("a", angles.dip_direction(n))
    off = angles.axial_difference(F.col("a"), F.col("dip_dir"), 360) > 1e-5
    return rows.groupBy("well").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.abs(F.col("d") - F.col("dip")) > 1e-5, 1)).alias("n_dip_off"),
        F.count(F.when((F.col("dip") > 0.5) & (F.col("dip") < 89.5) & off, 1)).alias("n_direction_off"),
    )


@query(
    f"WITH {v.LOG}, p AS (SELECT *, CASE WHEN dip = 0 THEN 0 ELSE sqrt(2.0::DOUBLE) * sin(radians(dip / 2)) END AS ra, tan(radians((90 - dip) / 2)) AS re FROM obs) "
    f"SELECT well, row_id, {r('ra * sin(radians(dip_dir))', 'ax', 5)}, {r('ra * cos(radians(dip_dir))', 'ay', 5)}, {r('re * sin(radians(dip_dir))', 'ex', 5)}, {r('re * cos(radians(dip_dir))', 'ey', 5)} FROM p"
)
def stereonet_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.log(spark, sf_dir)
    ax, ay = angles.equal_area_xy(F.col("dip"), F.col("dip_dir"))
    ex, ey = angles.equal_angle_xy(F.col("dip"), F.col("dip_dir"))
    return rounded(rows.select("well", "row_id", ax.alias("ax"), ay.alias("ay"), ex.alias("ex"), ey.alias("ey")), 5)


@query(f"WITH {v.LOG} SELECT ftype, floor(((dip_dir + 90) % 180) / 5)::BIGINT AS bin, count(*) AS n FROM obs GROUP BY ALL")
def rose_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    axial = angles.wrap(F.col("dip_dir") + 90, 180)
    return v.log(spark, sf_dir).groupBy("ftype", F.floor(axial / 5).alias("bin")).agg(F.count("*").alias("n"))


@query(
    f"WITH {v.LOG}, t AS (SELECT ftype, (dip_dir + 90) % 180 AS s FROM obs), d AS (SELECT ftype, s, unnest([0, 1, 2]) AS k, unnest([170.0::DOUBLE, 50.0::DOUBLE, 110.0::DOUBLE]) AS c FROM t), "
    "g AS (SELECT ftype, s, k, least(((s - c) % 180 + 180) % 180, 180 - ((s - c) % 180 + 180) % 180) AS far FROM (SELECT DISTINCT * FROM d)), b AS (SELECT DISTINCT ON (ftype, s) ftype, s, k FROM g ORDER BY ftype, s, far, k) "
    "SELECT ftype, k AS trace_set, count(*) AS n FROM t JOIN b USING (ftype, s) GROUP BY ALL"
)
def trace_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.log(spark, sf_dir).withColumn("trace_set", angles.trace_set(angles.wrap(F.col("dip_dir") + 90, 180)))
    return rows.groupBy("ftype", "trace_set").agg(F.count("*").alias("n"))


# filters and data quality


@query(
    f"WITH {v.RAW_LOG}, m AS (SELECT *, CASE WHEN depth IS NULL OR dip IS NULL OR dip_dir IS NULL THEN 'null' WHEN dip NOT BETWEEN 0 AND 90 OR dip_dir < 0 OR dip_dir >= 360 THEN 'out_of_range' ELSE 'ok' END AS base FROM raw_log), "
    "s AS (SELECT *, CASE WHEN base = 'ok' AND row_number() OVER (PARTITION BY well, depth, dip, dip_dir, base ORDER BY row_id) > 1 THEN 'duplicate' ELSE base END AS state FROM m), "
    "f AS (SELECT *, state = 'ok' AND depth < lag(depth) OVER (PARTITION BY well, state = 'ok' ORDER BY row_id, depth) AS falls FROM s) "
    "SELECT well::VARCHAR AS well, count(*) AS n_rows, count(*) FILTER (state = 'null') AS n_null, count(*) FILTER (state = 'out_of_range') AS n_out_of_range, count(*) FILTER (state = 'duplicate') AS n_duplicate, count(*) FILTER (state = 'ok') AS n_ok, count(*) FILTER (falls) AS n_falls, count(*) FILTER (falls) = 0 AS monotone, "
    "CASE WHEN count(*) FILTER (state = 'ok') >= 50 THEN 'A' WHEN count(*) FILTER (state = 'ok') >= 20 THEN 'B' ELSE 'F' END AS grade FROM f GROUP BY well"
)
def log_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(quality.flagged(v.raw_log(spark, sf_dir)))


@query(f"WITH {v.LOG} SELECT well, count(*) AS n, count(*) FILTER (abs(nz) >= sin(radians(10))) AS n_kept FROM obs GROUP BY well")
def censored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.log(spark, sf_dir)
    kept = quality.censored(rows).groupBy("well").agg(F.count("*").alias("n_kept"))
    return rows.groupBy("well").agg(F.count("*").alias("n")).join(kept, "well", "left").select("well", "n", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query(
    f"WITH {v.POINTS}, a AS (SELECT net, id, px * cos(radians(30)) + py * sin(radians(30)) AS t FROM pts), c AS (SELECT net, quantile_cont(t, 0.6) AS cut FROM a GROUP BY net) SELECT net, count(*) AS n, count(*) FILTER (t >= cut) AS n_observed FROM a JOIN c USING (net) GROUP BY net"
)
def spatial_block_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.spatial_block(v.points(spark, sf_dir).drop("is_obs"))
    return rows.groupBy("net").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_obs"), 1)).alias("n_observed"))


# ordered analytics

_GAPS = "SELECT {k}, count(*) AS n, " + ", ".join([r("avg(gap)", "mean"), r("quantile_cont(gap, 0.5)", "median"), r("quantile_cont(gap, 0.1)", "p10"), r("quantile_cont(gap, 0.9)", "p90")])


@query(f"WITH {v.LOG}, g AS (SELECT well, depth - lag(depth) OVER (PARTITION BY well ORDER BY depth, row_id) AS gap FROM obs) {_GAPS.format(k='well')} FROM g WHERE gap > 0 GROUP BY well")
def depth_gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ordered.gap_stats(v.log(spark, sf_dir), ["well"], "depth", "row_id"))


@query(
    f"WITH {v.DISCS}, a AS (SELECT net, id, px * sin(radians((id * 29) % 360 - 90)) + py * cos(radians((id * 29) % 360 - 90)) AS along FROM discs), g AS (SELECT net, along - lag(along) OVER (PARTITION BY net ORDER BY along, id) AS gap FROM a) {_GAPS.format(k='net')} FROM g WHERE gap > 0.001 GROUP BY net"
)
def spacing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.discs(spark, sf_dir).withColumn("dip_dir", F.pmod(F.col("id") * 29, F.lit(360)).cast("double"))
    return rounded(ordered.gap_stats(ordered.along_strike(rows), ["net"], "along", "id", noise=1e-3))


@query(
    f"WITH {v.STATIONS}, s AS (SELECT well, row_id, md, coalesce(md - lag(md) OVER w, 0) AS d, radians((hazi + coalesce(lag(hazi) OVER w, hazi)) / 2) AS az, radians((hdev + coalesce(lag(hdev) OVER w, hdev)) / 2) AS dv FROM st WINDOW w AS (PARTITION BY well ORDER BY md, row_id)) "
    f"SELECT well, count(*) AS n, max(md) - min(md) AS length, {r('sum(d * sin(dv) * sin(az))', 'east', 3)}, {r('sum(d * sin(dv) * cos(az))', 'north', 3)}, {r('sum(-d * cos(dv))', 'up', 3)} FROM s GROUP BY well"
)
def trajectory_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = ordered.trajectory(v.stations(spark, sf_dir), ["well"])
    last = path.groupBy("well").agg(F.count("*").alias("n"), (F.max("md") - F.min("md")).alias("length"), *(F.max_by(c, F.struct("md", "row_id")).alias(c) for c in ("east", "north", "up")))
    return rounded(last, 3)


# sets


@query(f"WITH {v.ASSIGNED} SELECT well, row_id, set_id, {r('angle', 'angle')} FROM assigned")
def set_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.assign(v.log(spark, sf_dir), v.reference_centers()).select("well", "row_id", "set_id", "angle"))


@query(
    f"WITH {v.ASSIGNED} SELECT well, set_id, count(*) AS n, {r('avg(angle)', 'mean_angle')}, {r('max(angle)', 'max_angle')}, {r('count(*) / sum(count(*)) OVER (PARTITION BY well)', 'proportion')}, count(*) >= 3 AS statistical FROM assigned GROUP BY well, set_id"
)
def set_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.set_dispersion(aggregates.assign(v.log(spark, sf_dir), v.reference_centers()), ["well"]))


@query(
    f"WITH {v.MEANS} SELECT well, set_id, n, {r('proportion', 'proportion')}, {r('mx', 'mx')}, {r('my', 'my')}, {r('mz', 'mz')}, {r('mean_angle', 'mean_angle')}, {r('kappa', 'kappa')}, {r('dip', 'dip')}, {r('dip_dir', 'dip_dir')}, "
    "CASE WHEN proportion * 100 >= 20 THEN 'strong' WHEN proportion * 100 >= 10 THEN 'moderate' WHEN proportion * 100 >= 5 THEN 'weak' ELSE 'sporadic' END AS development FROM tables"
)
def set_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set table of every well: the flagship."""
    out = aggregates.set_table(v.log(spark, sf_dir), ["well"], v.reference_centers())
    return rounded(out.withColumn("development", grades.development_grade(F.col("proportion") * 100)).select("well", "set_id", "n", "proportion", "mx", "my", "mz", "mean_angle", "kappa", "dip", "dip_dir", "development"))


@query(f"WITH {v.ASSIGNED} SELECT set_id, ftype, count(*) AS n, count(DISTINCT well) AS n_wells FROM assigned GROUP BY ALL")
def type_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.assign(v.log(spark, sf_dir), v.reference_centers())
    return rows.groupBy("set_id", "ftype").agg(F.count("*").alias("n"), F.countDistinct("well").alias("n_wells"))


_W = f"{v.LOG}, raw AS (SELECT *, 1 / greatest(1e-6::DOUBLE, least(1.0::DOUBLE, abs(nz))) AS w0 FROM obs), sc AS (SELECT *, w0 / avg(w0) OVER (PARTITION BY well) AS s FROM raw), tw AS (SELECT *, least(5.0::DOUBLE, greatest(0.1::DOUBLE, s)) AS w, s < 0.1 OR s > 5 AS clipped FROM sc)"


@query(
    f"WITH {_W} SELECT well, count(*) AS n, {r('sum(w) * sum(w) / sum(w * w)', 'ess')}, {r('avg(w)', 'w_mean')}, {r('min(w)', 'w_min')}, {r('max(w)', 'w_max')}, count(*) FILTER (clipped) AS n_clipped FROM tw GROUP BY well"
)
def terzaghi_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.effective_size(aggregates.terzaghi(v.log(spark, sf_dir), ["well"]), ["well"]))


@query(f"WITH {_W} SELECT well, " + ", ".join(r(f"sum(w * n{a} * n{b}) / sum(w)", f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM tw GROUP BY well")
def scatter_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.scatter(aggregates.terzaghi(v.log(spark, sf_dir), ["well"]), ["well"], F.col("w")))


def _eigen_sql(source: str, keys: str, size: str = "abs") -> str:
    """CTEs from `source` (keys, sxx .. szz): `eig` with l1 >= l2 >= l3 in closed form, `vec` with |components| of the first and last eigenvectors; with an empty size, components of one vector's signs."""
    cross = lambda lam: [  # noqa: E731  products of two rows of the matrix less lam; the longest is the direction
        (f"(sxy*syz - sxz*(syy-{lam}))", f"(sxz*sxy - (sxx-{lam})*syz)", f"((sxx-{lam})*(syy-{lam}) - sxy*sxy)"),
        (f"(sxy*(szz-{lam}) - sxz*syz)", f"(sxz*sxz - (sxx-{lam})*(szz-{lam}))", f"((sxx-{lam})*syz - sxy*sxz)"),
        (f"((syy-{lam})*(szz-{lam}) - syz*syz)", f"(syz*sxz - sxy*(szz-{lam}))", f"(sxy*syz - (syy-{lam})*sxz)"),
    ]
    longest = lambda lam: "[" + ", ".join(f"{{'n': {x}*{x} + {y}*{y} + {z}*{z}, 'x': {size}({x}), 'y': {size}({y}), 'z': {size}({z})}}" for x, y, z in cross(lam)) + "]"
    return (
        f"q0 AS (SELECT *, (sxx + syy + szz) / 3 AS q, sxy*sxy + sxz*sxz + syz*syz AS p1 FROM {source}), q1 AS (SELECT *, sqrt(((sxx-q)*(sxx-q) + (syy-q)*(syy-q) + (szz-q)*(szz-q) + 2*p1) / 6) AS p FROM q0), "
        "q2 AS (SELECT *, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((sxx-q)*((syy-q)*(szz-q) - syz*syz) - sxy*(sxy*(szz-q) - syz*sxz) + sxz*(sxy*syz - (syy-q)*sxz)) / (2*p*p*p)))) / 3 AS phi FROM q1), "
        "q3 AS (SELECT *, q + 2*p*cos(phi) AS l1, q + 2*p*cos(phi + 2*pi()/3) AS l3 FROM q2), eig AS (SELECT *, 3*q - l1 - l3 AS l2 FROM q3), "
        f"vec AS (SELECT {keys}, l1, l2, l3, list_reduce({longest('l1')}, lambda a, b: CASE WHEN b.n > a.n THEN b ELSE a END) AS e1, list_reduce({longest('l3')}, lambda a, b: CASE WHEN b.n > a.n THEN b ELSE a END) AS e3 FROM eig)"
    )


_SCATTER = ", ".join(f"sum(w * n{a} * n{b}) / sum(w) AS s{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query(
    f"WITH {_W}, sc2 AS (SELECT well, {_SCATTER} FROM tw GROUP BY well), {_eigen_sql('sc2', 'well')} SELECT well, {r('l1', 'l1')}, {r('l2', 'l2')}, {r('l3', 'l3')}, "
    + ", ".join(r(f"e1.{c} / sqrt(e1.n)", f"e1{c}", 3) for c in "xyz")
    + ", "
    + ", ".join(r(f"e3.{c} / sqrt(e3.n)", f"e3{c}", 3) for c in "xyz")
    + " FROM vec"
)
def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues of every well's weighted scatter, and the first and last axes without signs."""
    found = aggregates.eigen(aggregates.scatter(aggregates.terzaghi(v.log(spark, sf_dir), ["well"]), ["well"], F.col("w")), ["well"])
    axes = [F.round(F.abs(F.col(f"{e}{c}")), 3).alias(f"{e}{c}") for e in ("e1", "e3") for c in "xyz"]
    return found.select("well", *((F.round(F.col(c), 4) + F.lit(0.0)).alias(c) for c in ("l1", "l2", "l3")), *axes)


@query(
    f"WITH {v.LOG}, s AS (SELECT well, count(*) AS n, max(depth) - min(depth) AS depth_range FROM obs GROUP BY well) SELECT well, n, {r('depth_range', 'depth_range')}, {r('n / depth_range', 'p10')}, {r('n / depth_range * pi()', 'p32')} FROM s"
)
def p10_p32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.intensity(v.log(spark, sf_dir), ["well"]))


@query(
    f"WITH {v.DISCS}, k AS (SELECT * FROM discs WHERE radius BETWEEN 0.1 AND 20), m AS (SELECT net, greatest(0.5::DOUBLE, min(radius)) AS x_min FROM k GROUP BY net), s AS (SELECT net, count(*) AS n, any_value(x_min) AS x_min, sum(ln(radius / x_min)) AS s FROM k JOIN m USING (net) WHERE radius >= x_min GROUP BY net) "
    f"SELECT net, n, {r('x_min', 'x_min')}, {r('CASE WHEN n >= 10 AND s > 0 THEN least(5.0::DOUBLE, greatest(1.5::DOUBLE, 1 + n / s)) ELSE 3.5 END', 'beta')}, {r('CASE WHEN n >= 10 AND s > 0 THEN (n / s) / sqrt(n) END', 'beta_se')} FROM s"
)
def beta_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.power_law(v.discs(spark, sf_dir), ["net"], "radius", 1.0, 10.0))


@query(
    f"WITH {v.MEANS}, kk AS (SELECT a.well, a.set_id, avg(abs(nx*mx + ny*my + nz*mz)) AS r FROM assigned a JOIN means USING (well, set_id) GROUP BY ALL) "
    f"SELECT well, set_id, {r('r', 'r')}, {r('CASE WHEN r > 0.999 THEN 100 WHEN r < 0.01 THEN 0.01 ELSE least(100.0::DOUBLE, greatest(0.01::DOUBLE, r * (3 - r * r) / (1 - r * r))) END', 'kappa', 3)} FROM kk"
)
def resultant_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.log(spark, sf_dir)
    table = aggregates.set_table(rows, ["well"], v.reference_centers()).select("well", "set_id", "mx", "my", "mz")
    out = aggregates.kappa(aggregates.assign(rows, v.reference_centers()).drop("angle").join(table, ["well", "set_id"]), ["well", "set_id"])
    return out.select("well", "set_id", F.round("r", 4).alias("r"), F.round("kappa", 3).alias("kappa"))


@query(
    f"WITH {v.ASSIGNED}, l AS (SELECT well, set_id AS a, ascii(ftype) AS b FROM assigned), g AS (SELECT well, a, b, grouping(a, b) AS g, count(*) AS n FROM l GROUP BY GROUPING SETS ((well, a, b), (well, a), (well, b), (well))), "
    "s AS (SELECT well, sum(CASE WHEN g = 0 THEN n * (n - 1) / 2 ELSE 0 END) AS ab, sum(CASE WHEN g = 1 THEN n * (n - 1) / 2 ELSE 0 END) AS sa, sum(CASE WHEN g = 2 THEN n * (n - 1) / 2 ELSE 0 END) AS sb, sum(CASE WHEN g = 3 THEN n * (n - 1) / 2 ELSE 0 END) AS t, max(n) AS n FROM g GROUP BY well) "
    f"SELECT well, n, {r('CASE WHEN n < 2 THEN 0 WHEN abs((sa + sb) / 2 - sa * sb / t) < 1e-12 THEN CASE WHEN abs(ab - sa * sb / t) < 1e-12 THEN 1 ELSE 0 END ELSE (ab - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t) END', 'ari')} FROM s"
)
def rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.assign(v.log(spark, sf_dir), v.reference_centers())
    return rounded(aggregates.rand_index(rows, ["well"], "set_id", "ftype"))


@query()
def bootstrap_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.log(spark, sf_dir)
    table = aggregates.set_table(rows, ["well"], v.reference_centers()).select("well", "set_id", "mx", "my", "mz")
    placed = aggregates.assign(rows, v.reference_centers()).drop("angle").join(table, ["well", "set_id"])
    return rounded(aggregates.bootstrap_cone(placed, ["well", "set_id"]))


# spatial joins and predictors

_KNN = f"{v.POINTS}, near AS (SELECT h.net, h.id, o.id AS other, (h.px-o.px)*(h.px-o.px) + (h.py-o.py)*(h.py-o.py) + (h.pz-o.pz)*(h.pz-o.pz) AS d2, o.nx AS qx, o.ny AS qy, o.nz AS qz FROM pts h JOIN pts o USING (net) WHERE NOT h.is_obs AND o.is_obs), ranked AS (SELECT *, row_number() OVER (PARTITION BY net, id ORDER BY d2, other) AS rank FROM near)"


@query(
    f"WITH {v.POINTS}, n AS (SELECT a.net, a.id, b.id AS other, (a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) + (a.pz-b.pz)*(a.pz-b.pz) AS d2 FROM pts a JOIN pts b ON a.net = b.net AND a.id <> b.id), w AS (SELECT *, row_number() OVER (PARTITION BY net, id ORDER BY d2, other) AS rank FROM n) SELECT net, id, rank::INT AS rank, other, {r('d2', 'd2', 6)} FROM w WHERE rank <= 5"
)
def knn_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.points(spark, sf_dir)
    return rounded(neighbours.nearest(rows, rows, 5), 6)


@query(
    f"WITH {v.POINTS} SELECT a.net, a.id, count(*) AS n, {r('min((a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) + (a.pz-b.pz)*(a.pz-b.pz))', 'least', 6)} FROM pts a JOIN pts b ON a.net = b.net AND a.id <> b.id WHERE (a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) + (a.pz-b.pz)*(a.pz-b.pz) <= 0.1::DOUBLE * 0.1::DOUBLE GROUP BY a.net, a.id"
)
def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.points(spark, sf_dir)
    return rounded(neighbours.within(rows, rows, 0.1).groupBy("net", "id").agg(F.count("*").alias("n"), F.min("d2").alias("least")), 6)


@query(f"WITH {_KNN} SELECT net, id, {r('qx', 'qx')}, {r('qy', 'qy')}, {r('qz', 'qz')}, {r('d2', 'd2', 6)} FROM ranked WHERE rank = 1")
def nearest_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = predict.nearest_direction(predict.blind(v.points(spark, sf_dir)))
    return rounded(out.withColumn("d2", F.round("d2", 6)), 4).drop("d2").join(rounded(out.select("net", "id", "d2"), 6), ["net", "id"])


_ERR = f"{_KNN}, err AS (SELECT k.net, k.id, degrees(acos(least(1.0::DOUBLE, abs(k.qx*p.nx + k.qy*p.ny + k.qz*p.nz)))) AS error FROM ranked k JOIN pts p USING (net, id) WHERE rank = 1)"


@query(f"WITH {_ERR} SELECT net, count(*) AS n, {r('avg(error)', 'mae', 3)}, {r('quantile_cont(error, 0.5)', 'p50', 3)}, {r('quantile_cont(error, 0.9)', 'p90', 3)} FROM err GROUP BY net")
def hidden_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.points(spark, sf_dir)
    return rounded(aggregates.error_stats(predict.errors(predict.nearest_direction(predict.blind(rows)), rows), ["net"]), 3)


@query(
    f"WITH {_ERR}, a AS (SELECT id % 3 AS seed, net, avg(error) AS e FROM err GROUP BY ALL), b AS (SELECT seed, avg(e) AS e FROM a GROUP BY seed) SELECT count(*) AS n, {r('avg(e)', 'mae_mean', 3)}, {r('coalesce(stddev_samp(e), 0)', 'mae_std', 3)} FROM b"
)
def mae_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.points(spark, sf_dir)
    err = predict.errors(predict.nearest_direction(predict.blind(rows)), rows).withColumn("seed", F.pmod("id", F.lit(3)))
    return rounded(aggregates.two_level_mean(err, "seed", "net"), 3)


@query(
    f"WITH {_KNN}, {v.CENTERS}, sets AS (SELECT net, id AS other, set_id, row_number() OVER (PARTITION BY net, id ORDER BY abs(nx*cx+ny*cy+nz*cz) DESC, c.set_id) AS k FROM (SELECT net, id, nx, ny, nz FROM pts WHERE is_obs) p, centers c), "
    "v AS (SELECT r.net, r.id, s.set_id, count(*) AS votes FROM ranked r JOIN sets s ON r.net = s.net AND r.other = s.other AND s.k = 1 WHERE rank <= 16 GROUP BY ALL), b AS (SELECT net, id, set_id, votes, sum(votes) OVER (PARTITION BY net, id) AS total, row_number() OVER (PARTITION BY net, id ORDER BY votes DESC, set_id) AS k FROM v) "
    f"SELECT b.net, b.id, {r('CASE WHEN votes >= 0.6::DOUBLE * total THEN cx ELSE qx END', 'qx')}, {r('CASE WHEN votes >= 0.6::DOUBLE * total THEN cy ELSE qy END', 'qy')}, {r('CASE WHEN votes >= 0.6::DOUBLE * total THEN cz ELSE qz END', 'qz')} FROM b JOIN centers c ON b.set_id = c.set_id JOIN ranked f ON f.net = b.net AND f.id = b.id AND f.rank = 1 WHERE b.k = 1"
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predict.majority(predict.blind(v.points(spark, sf_dir)), v.reference_centers()))


_SET_AWARE = (
    f"{v.POINTS}, o AS (SELECT * FROM pts WHERE is_obs), f AS (SELECT net, set_id, arg_min(nx, id) AS rx, arg_min(ny, id) AS ry, arg_min(nz, id) AS rz FROM o GROUP BY ALL), s AS (SELECT net, set_id, avg(nx * g) AS x, avg(ny * g) AS y, avg(nz * g) AS z FROM (SELECT o.*, CASE WHEN nx*rx+ny*ry+nz*rz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g FROM o JOIN f USING (net, set_id)) GROUP BY ALL), fn AS (SELECT net, arg_min(nx, id) AS rx, arg_min(ny, id) AS ry, arg_min(nz, id) AS rz FROM o GROUP BY net), t AS (SELECT net, avg(nx * g) AS gx, avg(ny * g) AS gy, avg(nz * g) AS gz FROM (SELECT o.*, CASE WHEN nx*rx+ny*ry+nz*rz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g FROM o JOIN fn USING (net)) GROUP BY net), "
    "a AS (SELECT h.net, h.id, coalesce(x, gx) AS x, coalesce(y, gy) AS y, coalesce(z, gz) AS z FROM pts h JOIN t USING (net) LEFT JOIN s ON h.net = s.net AND h.set_id = s.set_id WHERE NOT h.is_obs)"
)


@query(
    f"WITH {_SET_AWARE} "
    f"SELECT net, id, {r('x / sqrt(x*x+y*y+z*z)', 'qx')}, {r('y / sqrt(x*x+y*y+z*z)', 'qy')}, {r('z / sqrt(x*x+y*y+z*z)', 'qz')} FROM a"
)
def set_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predict.set_aware(predict.blind(v.points(spark, sf_dir))))


@query(
    f"WITH {_SET_AWARE}, fc AS (SELECT net, fracture_id, count(*) AS n, avg(px) AS cx, avg(py) AS cy, avg(pz) AS cz FROM o GROUP BY ALL), "
    f"mo AS (SELECT net, fracture_id, {', '.join(f'avg((p{a} - c{a}) * (p{b} - c{b})) AS s{a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM o JOIN fc USING (net, fracture_id) WHERE n >= 3 GROUP BY ALL), {_eigen_sql('mo', 'net, fracture_id', '')}, "
    "pl AS (SELECT net, fracture_id, e3.x / sqrt(e3.n) AS fx, e3.y / sqrt(e3.n) AS fy, e3.z / sqrt(e3.n) AS fz FROM vec WHERE l2 > 1e-12), "
    "pr AS (SELECT p.net, nx, ny, nz, coalesce(fx, x / sqrt(x*x+y*y+z*z)) AS qx, coalesce(fy, y / sqrt(x*x+y*y+z*z)) AS qy, coalesce(fz, z / sqrt(x*x+y*y+z*z)) AS qz FROM pts p JOIN a ON a.net = p.net AND a.id = p.id LEFT JOIN pl ON pl.net = p.net AND pl.fracture_id = p.fracture_id WHERE NOT is_obs) "
    f"SELECT net, count(*) AS n, {r('avg(degrees(acos(least(1.0::DOUBLE, abs(nx*qx + ny*qy + nz*qz)))))', 'mae', 3)} FROM pr GROUP BY net"
)
def fracture_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.points(spark, sf_dir)
    return rounded(predict.errors(predict.fracture_aware(predict.blind(rows)), rows).groupBy("net").agg(F.count("*").alias("n"), F.avg("error").alias("mae")), 3)


@query()
def local_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.points(spark, sf_dir)
    return rounded(aggregates.error_stats(predict.errors(predict.local_median(predict.blind(rows)), rows), ["net"]), 2)


@query(
    f"WITH {v.POINTS}, sc AS (SELECT net, {', '.join(f'avg(n{a} * n{b}) AS s{a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM pts WHERE is_obs GROUP BY net), {_eigen_sql('sc', 'net', '')}, "
    "q AS (SELECT net, e1.x / sqrt(e1.n) AS qx, e1.y / sqrt(e1.n) AS qy, e1.z / sqrt(e1.n) AS qz FROM vec), er AS (SELECT p.net, degrees(acos(least(1.0::DOUBLE, abs(nx*qx + ny*qy + nz*qz)))) AS error FROM pts p JOIN q USING (net) WHERE NOT is_obs) "
    f"SELECT net, count(*) AS n, {r('avg(error)', 'mae', 3)}, {r('quantile_cont(error, 0.5)', 'p50', 3)}, {r('quantile_cont(error, 0.9)', 'p90', 3)} FROM er GROUP BY net"
)
def global_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.points(spark, sf_dir)
    return rounded(aggregates.error_stats(predict.errors(predict.global_direction(predict.blind(rows)), rows), ["net"]), 3)


def _predicted(rows: DataFrame) -> dict[str, DataFrame]:
    """Predictions (net, id, qx, qy, qz) of every predictor; they share one search for nearest rows and one clustering."""
    c, kept = v.reference_centers(), written(rows, "predictor-rows")
    near, sets = predict.looked_up(kept, 24), predict.observed_centers(kept, (4, 3, 5, 6))
    made = {
        "nearest": predict.nearest_direction(kept, near),
        "global": predict.global_direction(kept),
        "majority": predict.majority(kept, c, found=near),
        "set_aware": predict.set_aware(kept),
        "set_aware_observed": predict.set_aware_observed(kept, c, near),
        "fracture_aware": predict.fracture_aware(kept),
        "local_median": predict.local_median(kept),
        "top_two": predict.top_two(kept, c, found=near),
        "set_aware_k4": predict.set_aware_observed(kept, sets[4], near),
        "set_aware_k6": predict.set_aware_observed(kept, sets[6], near),
        "top_two_ensemble": predict.top_two_ensemble(kept, found=near, centers=sets),
        "global_median": predict.global_median_direction(kept),
    }
    return {name: written(p.select("net", "id", "qx", "qy", "qz"), "predicted") for name, p in made.items()}


@query(
    f"WITH {v.POINTS} SELECT predictor, net, count(*) AS n, 0::BIGINT AS n_changed FROM pts, (SELECT unnest(['nearest', 'global', 'majority', 'set_aware', 'set_aware_observed', 'fracture_aware', 'local_median', 'top_two', 'set_aware_k4', 'set_aware_k6', 'top_two_ensemble', 'global_median']) AS predictor) WHERE NOT is_obs GROUP BY ALL"
)
def poison_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of every predictor that change when hidden normals are replaced: none may."""
    rows, out = v.points(spark, sf_dir), None
    named = lambda df: df.withColumnsRenamed({f"q{c}": f"p{c}" for c in "xyz"})
    again = _predicted(predict.poisoned(rows, 12345))
    for name, first in _predicted(predict.blind(rows)).items():
        changed = quality.leaks(named(first), named(again[name]))
        one = first.groupBy("net").agg(F.count("*").alias("n")).join(changed, "net").select(F.lit(name).alias("predictor"), "net", "n", "n_changed")
        out = one if out is None else out.unionByName(one)
    return out


_MU = (
    f"{v.CENTERS}, asg AS (SELECT net, id, nx, ny, nz, c.set_id, cx, cy, cz, row_number() OVER (PARTITION BY net, id ORDER BY abs(nx*cx+ny*cy+nz*cz) DESC, c.set_id) AS k FROM (SELECT * FROM pts WHERE is_obs) p, centers c), "
    "mu0 AS (SELECT net, set_id, sum(nx*g) AS x, sum(ny*g) AS y, sum(nz*g) AS z FROM (SELECT *, CASE WHEN nx*cx+ny*cy+nz*cz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g FROM asg WHERE k = 1) GROUP BY ALL), mu AS (SELECT net, set_id, x/sqrt(x*x+y*y+z*z) AS ux, y/sqrt(x*x+y*y+z*z) AS uy, z/sqrt(x*x+y*y+z*z) AS uz FROM mu0)"
)


@query(
    f"WITH {_KNN}, {_MU}, j AS (SELECT r.net, r.id, ux, uy, uz, CASE WHEN ux*qx+uy*qy+uz*qz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g FROM ranked r JOIN asg a ON a.net = r.net AND a.id = r.other AND a.k = 1 JOIN mu ON mu.net = r.net AND mu.set_id = a.set_id WHERE rank = 1) "
    f"SELECT net, id, {r('ux * g', 'qx')}, {r('uy * g', 'qy')}, {r('uz * g', 'qz')} FROM j"
)
def set_aware_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predict.set_aware_observed(predict.blind(v.points(spark, sf_dir)), v.reference_centers()))


@query(
    f"WITH {_KNN}, {_MU}, vt AS (SELECT r.net, r.id, a.set_id, count(*) AS n FROM ranked r JOIN asg a ON a.net = r.net AND a.id = r.other AND a.k = 1 WHERE rank <= 24 GROUP BY ALL), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY net, id ORDER BY n DESC, set_id) AS o, sum(n) OVER (PARTITION BY net, id) AS s FROM vt), "
    "two AS (SELECT a.net, a.id, a.set_id AS s1, coalesce(b.set_id, a.set_id) AS s2, a.n / a.s AS f1, coalesce(b.n, 0) / a.s AS f2 FROM o a LEFT JOIN o b ON a.net = b.net AND a.id = b.id AND b.o = 2 WHERE a.o = 1), "
    "d AS (SELECT t.net, t.id, qx, qy, qz, 0.6::DOUBLE * f2 / (f1 + f2) AS t, least(1.0::DOUBLE, f1 / 0.8::DOUBLE) AS f, m1.ux AS ax, m1.uy AS ay, m1.uz AS az, m2.ux AS bx, m2.uy AS by_, m2.uz AS bz, CASE WHEN m1.ux*qx+m1.uy*qy+m1.uz*qz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS ga, CASE WHEN m2.ux*qx+m2.uy*qy+m2.uz*qz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS gb "
    "FROM two t JOIN ranked r ON r.net = t.net AND r.id = t.id AND r.rank = 1 JOIN mu m1 ON m1.net = t.net AND m1.set_id = s1 JOIN mu m2 ON m2.net = t.net AND m2.set_id = s2), "
    "x AS (SELECT *, ax*ga*(1-t) + bx*gb*t AS sx, ay*ga*(1-t) + by_*gb*t AS sy, az*ga*(1-t) + bz*gb*t AS sz FROM d), y AS (SELECT net, id, sx/sqrt(sx*sx+sy*sy+sz*sz)*f + qx*(1-f) AS dx, sy/sqrt(sx*sx+sy*sy+sz*sz)*f + qy*(1-f) AS dy, sz/sqrt(sx*sx+sy*sy+sz*sz)*f + qz*(1-f) AS dz FROM x) "
    f"SELECT net, id, {r('dx / sqrt(dx*dx+dy*dy+dz*dz)', 'qx')}, {r('dy / sqrt(dx*dx+dy*dy+dz*dz)', 'qy')}, {r('dz / sqrt(dx*dx+dy*dy+dz*dz)', 'qz')} FROM y"
)
def top_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predict.top_two(predict.blind(v.points(spark, sf_dir)), v.reference_centers()))


@query(
    f"WITH {v.POINTS}, {_MU}, er AS (SELECT p.net, p.id, min(degrees(acos(least(1.0::DOUBLE, abs(nx*ux+ny*uy+nz*uz))))) AS error FROM pts p JOIN mu USING (net) WHERE NOT is_obs GROUP BY ALL) SELECT net, count(*) AS n, {r('avg(error)', 'mae', 3)}, {r('quantile_cont(error, 0.5)', 'p50', 3)}, {r('quantile_cont(error, 0.9)', 'p90', 3)} FROM er GROUP BY net"
)
def truth_assign_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least errors that the observed sets allow."""
    rows = v.points(spark, sf_dir)
    return rounded(aggregates.error_stats(predict.errors(predict.truth_assigned(predict.blind(rows), rows, v.reference_centers()), rows), ["net"]), 3)


@query()
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every predictor, and of the mean of three, on every net."""
    rows = v.points(spark, sf_dir)
    made = _predicted(predict.blind(rows))
    three = predict.fused([made[name] for name in ("top_two", "local_median", "set_aware_observed")])
    return rounded(predict.scored(rows, made | {"mean_of_three": three}), 2)


_SPREAD = "sp AS (SELECT net, greatest((stddev_pop(px) + stddev_pop(py) + stddev_pop(pz)) / 3, 1e-6::DOUBLE) AS rad FROM pts GROUP BY net)"


@query(
    f"WITH {v.POINTS}, {_SPREAD}, m AS (SELECT h.net, h.id, sqrt((h.px-o.px)*(h.px-o.px) + (h.py-o.py)*(h.py-o.py) + (h.pz-o.pz)*(h.pz-o.pz)) / rad AS d, o.nx, o.ny, o.nz FROM pts h JOIN pts o USING (net) JOIN sp USING (net) WHERE NOT h.is_obs AND o.is_obs) "
    f"SELECT net, id, {r('min(d)', 'dmin')}, {r('coalesce(sqrt(pow(avg(nx) FILTER (d <= 0.5), 2) + pow(avg(ny) FILTER (d <= 0.5), 2) + pow(avg(nz) FILTER (d <= 0.5), 2)), 0)', 'resultant')} FROM m GROUP BY net, id"
)
def support_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predict.support(predict.blind(v.points(spark, sf_dir))))


@query(
    f"WITH {_ERR}, o AS (SELECT net, avg(nx*nx) AS sxx, avg(nx*ny) AS sxy, avg(nx*nz) AS sxz, avg(ny*ny) AS syy, avg(ny*nz) AS syz, avg(nz*nz) AS szz FROM pts WHERE is_obs AND net % 2 = 0 GROUP BY net UNION ALL SELECT net, avg(nx*nx), avg(nx*ny), avg(nx*nz), avg(ny*ny), avg(ny*nz), avg(nz*nz) FROM pts WHERE is_obs AND net % 2 = 1 AND id % 5 = 0 GROUP BY net), "
    f"{_eigen_sql('o', 'net')}, t AS (SELECT error, CASE WHEN (l1 - l3) * 4 >= 0.5 THEN 'high' WHEN (l1 - l3) * 4 >= 0.25 THEN 'middle' ELSE 'low' END AS tier FROM err JOIN eig USING (net)) SELECT tier, count(*) AS n, {r('avg(error)', 'mae', 3)}, {r('quantile_cont(error, 0.5)', 'p50', 3)} FROM t GROUP BY tier"
)
def error_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the nearest normal by the anisotropy of a net's observed normals, four times l1 - l3; odd nets by a fifth of them."""
    rows = v.points(spark, sf_dir)
    seen = rows.filter("is_obs and (net % 2 = 0 or id % 5 = 0)")
    spread = aggregates.eigen(aggregates.scatter(seen, ["net"]), ["net"]).select("net", ((F.col("l1") - F.col("l3")) * 4).alias("anisotropy"))
    errors = predict.errors(predict.nearest_direction(predict.blind(rows)), rows).join(spread, "net")
    return rounded(aggregates.stratified(errors), 3)


@query(f"WITH {v.POINTS} SELECT net, fracture_id, count(*) FILTER (is_obs) AS n_seen, count(*) FILTER (NOT is_obs) AS n_hidden FROM pts GROUP BY ALL HAVING count(*) FILTER (is_obs) >= 2 AND count(*) FILTER (NOT is_obs) > 0")
def usable_fractures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.usable_nets(v.points(spark, sf_dir), ["net", "fracture_id"])


_PAIRS = f"{v.POINTS}, n AS (SELECT a.net, a.id, b.id AS other, (a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) + (a.pz-b.pz)*(a.pz-b.pz) AS d2, b.px - a.px AS x, b.py - a.py AS y, b.pz - a.pz AS z FROM pts a JOIN pts b ON a.net = b.net)"


@query(
    f"WITH {_PAIRS}, w AS (SELECT *, row_number() OVER (PARTITION BY net, id ORDER BY d2, other) AS rank FROM n WHERE id <> other), f AS (SELECT net, id, sqrt(max(d2)) AS far FROM w WHERE rank <= 8 GROUP BY ALL) SELECT net, count(*) AS n, {r('quantile_cont(far, 0.5)', 'scale')} FROM f GROUP BY net"
)
def knn_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.knn_scale(v.points(spark, sf_dir)))


@query(
    f"WITH {_PAIRS}, w AS (SELECT *, row_number() OVER (PARTITION BY net, id ORDER BY d2, other) AS rank FROM n), c AS (SELECT net, id, avg(x*x) - avg(x)*avg(x) AS sxx, avg(x*y) - avg(x)*avg(y) AS sxy, avg(x*z) - avg(x)*avg(z) AS sxz, avg(y*y) - avg(y)*avg(y) AS syy, avg(y*z) - avg(y)*avg(z) AS syz, avg(z*z) - avg(z)*avg(z) AS szz FROM w WHERE rank <= 16 GROUP BY ALL), {_eigen_sql('c', 'net, id')} "
    f"SELECT net, id, {r('l1', 'l1')}, {r('l2', 'l2')}, {r('l3', 'l3')}, " + ", ".join(r(f"e3.{c} / sqrt(e3.n)", f"n{c}", 3) for c in "xyz") + " FROM vec"
)
def local_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each point's 16 nearest, and the normal of their plane without sign."""
    found = neighbours.local_planes(v.points(spark, sf_dir))
    return found.select("net", "id", *((F.round(F.col(c), 4) + F.lit(0.0)).alias(c) for c in ("l1", "l2", "l3")), *(F.round(F.abs(F.col(f"e3{c}")), 3).alias(f"n{c}") for c in "xyz"))


@query(f"WITH {v.LOG} SELECT well, {r('max(degrees(acos(least(1.0::DOUBLE, abs(nz)))))', 'deviation')} FROM obs GROUP BY well")
def axis_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.axis_deviation(v.log(spark, sf_dir), ["well"]))


@query()
def em_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An axial mixture of four sets for every type of fracture by EM, decoded to a set table."""
    rows = v.log(spark, sf_dir).withColumnsRenamed({"ftype": "net", "row_id": "id"})
    return rounded(clusters.decoded(clusters.em_mixture(rows, clusters.starting_centers(rows, 4))), 3)


@query(
    f"WITH {_ERR}, d AS (SELECT e.net, e.error, k.d2 FROM err e JOIN ranked k ON e.net = k.net AND e.id = k.id AND k.rank = 1), w AS (SELECT net, rank() OVER (PARTITION BY net ORDER BY error) + (count(*) OVER (PARTITION BY net, error) - 1) / 2 AS x, rank() OVER (PARTITION BY net ORDER BY d2) + (count(*) OVER (PARTITION BY net, d2) - 1) / 2 AS y FROM d) SELECT net, count(*) AS n, {r('corr(x, y)', 'rho')} FROM w GROUP BY net"
)
def error_distance_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.points(spark, sf_dir)
    return rounded(aggregates.rank_correlation(predict.errors(predict.nearest_direction(predict.blind(rows)), rows), ["net"], "error", "d2"))


# clusters

_STEP = (
    "sim{i} AS (SELECT p.*, c.set_id AS k, c.cx, c.cy, c.cz, row_number() OVER (PARTITION BY rid ORDER BY abs(nx*c.cx + ny*c.cy + nz*c.cz) DESC, c.set_id) AS r FROM obs p JOIN c{i} c USING (well)), "
    "sum{i} AS (SELECT well, k, sum(nx * g) AS x, sum(ny * g) AS y, sum(nz * g) AS z FROM (SELECT *, CASE WHEN nx*cx+ny*cy+nz*cz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g FROM sim{i} WHERE r = 1) GROUP BY ALL), "
    "c{j} AS (SELECT c.well, c.set_id, coalesce(x / sqrt(x*x+y*y+z*z), cx) AS cx, coalesce(y / sqrt(x*x+y*y+z*z), cy) AS cy, coalesce(z / sqrt(x*x+y*y+z*z), cz) AS cz FROM c{i} c LEFT JOIN sum{i} s ON c.well = s.well AND c.set_id = s.k)"
)


def _clustered(spark: SparkSession, sf_dir: str, rounds: int) -> tuple[DataFrame, DataFrame]:
    rows = v.log(spark, sf_dir).withColumnsRenamed({"well": "net", "row_id": "id"})
    start = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(center, "xyz"))) for center in v.reference_centers()))
    return rows, clusters.lloyd(rows, rows.select("net").distinct().withColumn("centers", start), rounds)


@query(
    f"WITH {v.LOG}, {v.CENTERS}, c0 AS (SELECT well, set_id, cx, cy, cz FROM (SELECT DISTINCT well FROM obs), centers), "
    + ", ".join(_STEP.format(i=i, j=i + 1) for i in range(3))
    + f" SELECT well, set_id, {r('cx', 'cx')}, {r('cy', 'cy')}, {r('cz', 'cz')} FROM c3"
)
def lloyd_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of spherical k-means from the reference centers, in every well."""
    _, centers = _clustered(spark, sf_dir, 3)
    return rounded(centers.select(F.col("net").alias("well"), F.posexplode("centers").alias("set_id", "c")).select("well", "set_id", *(F.col(f"c.{c}").alias(f"c{c}") for c in "xyz")))


@query(
    f"WITH {v.ASSIGNED}, sz AS (SELECT well, set_id, count(*) AS m FROM assigned GROUP BY ALL), big AS (SELECT well, count(*) AS n_big FROM sz WHERE m > 1 GROUP BY well), "
    "o AS (SELECT a.well, a.rid, any_value(CASE WHEN z.m > 1 THEN 1 - least(1.0::DOUBLE, a.s) ELSE 0 END) AS a, any_value(coalesce(n_big, 0)) AS n_big, 1 - max(CASE WHEN x.set_id <> a.set_id AND zx.m > 1 THEN least(1.0::DOUBLE, x.s) END) AS b FROM assigned a JOIN sz z ON z.well = a.well AND z.set_id = a.set_id JOIN sims x ON x.rid = a.rid LEFT JOIN sz zx ON zx.well = a.well AND zx.set_id = x.set_id LEFT JOIN big ON big.well = a.well GROUP BY a.well, a.rid), "
    "f AS (SELECT well, a, CASE WHEN n_big <= 1 THEN 0 ELSE b END AS b FROM o) "
    f"SELECT well, count(*) AS n, {r('avg((b - a) / greatest(a, b, 1e-9::DOUBLE))', 'silhouette')} FROM f GROUP BY well"
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centers = _clustered(spark, sf_dir, 0)
    return rounded(clusters.silhouette(clusters.labelled(rows, centers), ["net"]).withColumnRenamed("net", "well"))


@query()
def choose_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two to eight sets for every type of fracture, over all its rows."""
    rows = v.log(spark, sf_dir).withColumnsRenamed({"ftype": "net", "row_id": "id"})
    return rounded(clusters.choose_k(rows, 2, 8))


_ANCHORED = 3


def _joint_sql() -> str:
    """Rounds of k-means over a site's rows from given centers; a center that no row goes to stays."""
    place = lambda i: (
        f"p{i} AS (SELECT * FROM (SELECT o.rid, o.ftype, o.well, nx, ny, nz, c.k, cx, cy, cz, abs(nx*cx + ny*cy + nz*cz) AS s, row_number() OVER (PARTITION BY o.rid ORDER BY abs(nx*cx + ny*cy + nz*cz) DESC, c.k) AS r FROM lg o JOIN c{i} c USING (ftype)) WHERE r = 1)"
    )
    move = lambda i: (
        f"m{i} AS (SELECT ftype, k, sum(nx*g) AS x, sum(ny*g) AS y, sum(nz*g) AS z FROM (SELECT *, CASE WHEN nx*cx + ny*cy + nz*cz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g FROM p{i}) GROUP BY ALL), "
        f"c{i + 1} AS (SELECT c.ftype, c.k, coalesce(x / sqrt(x*x+y*y+z*z), cx) AS cx, coalesce(y / sqrt(x*x+y*y+z*z), cy) AS cy, coalesce(z / sqrt(x*x+y*y+z*z), cz) AS cz FROM c{i} c LEFT JOIN m{i} m ON c.ftype = m.ftype AND c.k = m.k)"
    )
    first = f"{v.LOG}, {v.CENTERS}, lg AS MATERIALIZED (SELECT * FROM obs), c0 AS (SELECT ftype, set_id AS k, cx, cy, cz FROM (SELECT DISTINCT ftype FROM lg), centers)"
    return f"WITH {first}, " + ", ".join(f"{place(i)}, {move(i)}" for i in range(_ANCHORED)) + f", {place(_ANCHORED)} "


@query(_joint_sql() + f"SELECT ftype, well AS net, k AS set_id, count(*) AS n, {r('avg(degrees(acos(least(1.0::DOUBLE, s))))', 'mean_angle', 3)} FROM p{_ANCHORED} GROUP BY ALL")
def joint_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets that all wells of one type of site share, from given anchors, and how far every well lies from them."""
    rows = v.log(spark, sf_dir).select("ftype", F.col("well").alias("net"), F.col("row_id").alias("id"), "nx", "ny", "nz")
    placed = clusters.joint_sets(rows, len(v.REFERENCE), "ftype", v.reference_centers(), rounds=_ANCHORED)
    return rounded(clusters.joint_dispersion(placed, "ftype"), 3)


@query()
def observed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of each net from its observed rows by the best of 20 starts, and the rows that go to each."""
    placed = clusters.observed_sets(v.points(spark, sf_dir), len(v.REFERENCE))
    return rounded(placed.groupBy("net", "set_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_obs"), 1)).alias("n_observed"), F.avg("similarity").alias("similarity")), 3)


@query()
def plane_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes found in every cloud, their points, and the share of those from the sheet that most are from."""
    points = v.cloud(spark, sf_dir)
    labels = planes.ransac_planes(points, tolerance=0.2, most=8)[0]
    sheets = labels.join(points.select("net", "id", "sheet"), ["net", "id"]).groupBy("net", "plane", "sheet").agg(F.count("*").alias("n"))
    return rounded(sheets.groupBy("net", "plane").agg(F.sum("n").alias("n"), F.max_by("sheet", F.struct("n", "sheet")).alias("sheet"), (F.max("n") / F.sum("n")).alias("purity")))


# matching and fusing tables


def _tables(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    return aggregates.set_table(v.log(spark, sf_dir), [by], v.reference_centers())


@query(
    f"WITH {v.MEANS} SELECT a.well, a.set_id AS set_a, b.set_id AS set_b, {r('degrees(acos(least(1.0::DOUBLE, abs(a.mx*b.mx + a.my*b.my + a.mz*b.mz))))', 'angle')} FROM tables a JOIN tables b ON a.well = b.well AND a.set_id < b.set_id"
)
def set_pair_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screening.set_pairs(_tables(spark, sf_dir, "well"), ["well"]))


@query(
    f"WITH {v.MEANS}, p AS (SELECT a.well, a.set_id AS x, b.set_id AS y FROM tables a JOIN tables b ON a.well = b.well AND a.set_id <> b.set_id AND degrees(acos(least(1.0::DOUBLE, abs(a.mx*b.mx + a.my*b.my + a.mz*b.mz)))) < 50) SELECT well, x AS set_id, string_agg(y::VARCHAR, ',' ORDER BY y) AS remark FROM p GROUP BY ALL"
)
def near_duplicate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.near_duplicate_remarks(_tables(spark, sf_dir, "well"), ["well"], below=50.0)


def _means(key: str) -> str:
    """The set tables of v.MEANS by another key of a line than its supplier; their name stays `well`."""
    return v.MEANS.replace("l_suppkey AS well", f"{key} AS well")


#: The cheapest one-to-one matching of every two tables of up to four sets: as many pairs as can be, then the least sum of angles.
_MATCHED = (
    "pm AS (SELECT 64 * i + 16 * j + 4 * k + l AS perm, [i, j, k, l] AS p FROM range(4) t1(i), range(4) t2(j), range(4) t3(k), range(4) t4(l) WHERE i <> j AND i <> k AND i <> l AND j <> k AND j <> l AND k <> l), "
    "ang AS (SELECT a.well AS a, b.well AS b, a.set_id AS set_a, b.set_id AS set_b, degrees(acos(least(1.0::DOUBLE, abs(a.mx*b.mx + a.my*b.my + a.mz*b.mz)))) AS angle FROM tables a JOIN tables b ON a.well < b.well), "
    "tot AS (SELECT a, b, perm, count(*) AS n_matched, sum(angle) AS total FROM ang JOIN pm ON p[set_a + 1] = set_b GROUP BY ALL), "
    "best AS (SELECT a, b, perm FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n_matched DESC, total, perm) AS o FROM tot) WHERE o = 1), "
    "mat AS (SELECT ang.a, ang.b, set_a, set_b, angle FROM ang JOIN best ON best.a = ang.a AND best.b = ang.b JOIN pm USING (perm) WHERE p[set_a + 1] = set_b)"
)
_CONSISTENT = (
    f"{_means('(SELECT s_nationkey FROM supplier WHERE s_suppkey = l_suppkey)')}, {_MATCHED}, sz AS (SELECT well, count(*) AS k FROM tables GROUP BY well), ms AS (SELECT a, b, count(*) AS n_matched, sum(angle) AS total FROM mat GROUP BY ALL), "
    "con AS (SELECT a, b, n_matched, (total + (greatest(x.k, y.k) - n_matched) * 90) / greatest(x.k, y.k) AS mean_angle FROM ms JOIN sz x ON x.well = a JOIN sz y ON y.well = b)"
)
_RECONCILED = (
    f"{_means('l_returnflag')}, {_MATCHED}, two AS (SELECT * FROM mat WHERE a = 'A' AND b = 'N'), rec AS (SELECT set_a, set_b, angle, CASE WHEN angle < 20 THEN 'green' WHEN angle < 35 THEN 'yellow' ELSE 'red' END AS light, CASE WHEN angle < 20 THEN 'fused' ELSE 'excluded' END AS outcome FROM two "
    "UNION ALL SELECT set_id, NULL, NULL, 'yellow', 'single' FROM tables WHERE well = 'A' AND set_id NOT IN (SELECT set_a FROM two) UNION ALL SELECT NULL, set_id, NULL, 'yellow', 'single' FROM tables WHERE well = 'N' AND set_id NOT IN (SELECT set_b FROM two))"
)


@query(f"WITH {_CONSISTENT} SELECT a, b, n_matched, {r('mean_angle', 'mean_angle')}, CASE WHEN mean_angle < 20 THEN 'consistent' WHEN mean_angle < 35 THEN 'partial' ELSE 'conflict' END AS verdict FROM con")
def well_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched sets of every two suppliers' nations, and what they say: wells are pooled by nation first."""
    return rounded(_nation_pairs(spark, sf_dir))


def _nation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("well"), F.col("s_nationkey").alias("table"))
    return aggregates.set_table(v.log(spark, sf_dir).join(nation, "well"), ["table"], v.reference_centers())


def _nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _nation_tables(spark, sf_dir)
    return fusion.consistency(fusion.matches(fusion.table_pairs(tables, "table")), sizes=tables.groupBy("table").agg(F.count("*").alias("k")))


@query(
    f"WITH RECURSIVE {_CONSISTENT}, bo AS (SELECT a AS t, b AS o, mean_angle FROM con UNION ALL SELECT b, a, mean_angle FROM con), bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY mean_angle, o) AS n FROM bo) WHERE n = 1), "
    "told AS (SELECT well AS t, o, coalesce(mean_angle, 999) AS m, CASE WHEN coalesce(mean_angle, 999) < 20 THEN 'joint' WHEN coalesce(mean_angle, 999) < 35 THEN 'pair_only' ELSE 'independent' END AS tier FROM sz LEFT JOIN bp ON t = well), "
    "ed AS (SELECT a, b FROM con WHERE mean_angle < 20 UNION ALL SELECT t, o FROM told WHERE tier = 'pair_only'), sd AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), rch(t, place) AS (SELECT t, t FROM told UNION SELECT x.t, e.b FROM rch x JOIN sd e ON x.place = e.a), pl AS (SELECT t, min(place) AS pool FROM rch GROUP BY t) "
    f"SELECT t AS \"table\", {r('m', 'best_angle')}, tier, pool FROM told JOIN pl USING (t)"
)
def joint_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.joint_pools(_nation_pairs(spark, sf_dir), _nation_tables(spark, sf_dir)))


@query(f"WITH {_RECONCILED} SELECT set_a, set_b, {r('angle', 'angle')}, light, outcome FROM rec")
def reconcile_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.reconcile(_tables(spark, sf_dir, "ftype"), "ftype", "A", "N"))


@query(
    f"WITH {_RECONCILED}, sd AS (SELECT set_a, set_b, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb, coalesce(x.mx, 0) AS ax, coalesce(x.my, 0) AS ay, coalesce(x.mz, 0) AS az, coalesce(y.mx, 0) AS bx, coalesce(y.my, 0) AS by_, coalesce(y.mz, 0) AS bz, greatest(x.kappa, y.kappa) AS kappa "
    "FROM rec LEFT JOIN tables x ON x.well = 'A' AND x.set_id = set_a LEFT JOIN tables y ON y.well = 'N' AND y.set_id = set_b WHERE outcome <> 'excluded'), g AS (SELECT *, sqrt(nb) * CASE WHEN ax*bx + ay*by_ + az*bz < 0 THEN -1 ELSE 1 END AS w FROM sd), "
    "u AS (SELECT *, sqrt(na)*ax + w*bx AS x, sqrt(na)*ay + w*by_ AS y, sqrt(na)*az + w*bz AS z FROM g) "
    f"SELECT set_a, set_b, na + nb AS n, {', '.join(r(f'{c} / sqrt(x*x + y*y + z*z)', f'm{c}') for c in 'xyz')}, {r('kappa', 'kappa')} FROM u"
)
def fused_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.fused_centers(_tables(spark, sf_dir, "ftype"), "ftype", "A", "N"))


@query()
def typed_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of every source and kind of structure, a third of the wells of no known kind, merged where they have one direction."""
    kind = F.get(F.array(F.lit("natural"), F.lit("induced"), F.lit(None)), F.pmod("well", F.lit(3)).cast("int"))
    tables = aggregates.set_table(v.log(spark, sf_dir).withColumn("kind", F.coalesce(kind, F.lit("unknown"))), ["ftype", "kind"], v.reference_centers())
    return rounded(fusion.fused_spaces(fusion.typed_spaces(tables, "ftype")).withColumn("kinds", F.concat_ws(",", "kinds")))


@query(
    f"WITH {_means('l_returnflag')}, {_MATCHED}, mt AS (SELECT coalesce(avg(angle), 90) AS modal_error, count(*) FILTER (angle < 30) AS n_success FROM mat WHERE a = 'N' AND b = 'R'), ks AS (SELECT count(*) FILTER (well = 'R') AS kp, count(*) FILTER (well = 'N') AS kt FROM tables) "
    f"SELECT {r('modal_error', 'modal_error')}, kp - kt AS k_diff, {r('n_success / greatest(kt, 1)', 'coverage')}, n_success FROM mt, ks"
)
def table_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _tables(spark, sf_dir, "ftype")
    return rounded(fusion.table_score(tables.filter("ftype = 'R'"), tables.filter("ftype = 'N'")))


@query(
    f"WITH {v.LOG}, s AS (SELECT well, ftype, count(*) AS n FROM obs GROUP BY ALL) SELECT ftype, count(*) AS n_entries, sum(n)::BIGINT AS n_obs, max(n) AS largest FROM s GROUP BY ftype"
)
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = v.log(spark, sf_dir).groupBy("well", "ftype").agg(F.count("*").alias("n"))
    return entries.groupBy("ftype").agg(F.count("*").alias("n_entries"), F.sum("n").alias("n_obs"), F.max("n").alias("largest"))


# networks


_EDGES = f"{v.DISCS}, edges AS (SELECT a.net, a.id AS a, b.id AS b FROM discs a JOIN discs b ON a.net = b.net AND a.id < b.id WHERE (a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) + (a.pz-b.pz)*(a.pz-b.pz) < (a.radius + b.radius) * (a.radius + b.radius))"


@query(f"WITH {_EDGES} SELECT net, a, b FROM edges")
def disc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.disc_edges(v.discs(spark, sf_dir), 11.0)


@query(
    f"WITH {v.DISCS} SELECT a.net, a.id AS a, b.id AS b FROM discs a JOIN discs b ON a.net = b.net AND a.id < b.id WHERE "
    + " + ".join(f"pow(least(abs(a.{c}-b.{c}), 100 - abs(a.{c}-b.{c})), 2)" for c in ("px", "py", "pz"))
    + " < (a.radius + b.radius) * (a.radius + b.radius)"
)
def periodic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.disc_edges(v.discs(spark, sf_dir), 11.0, (100.0, 100.0, 100.0))


_COMPONENTS = (
    f"{_EDGES}, sides AS (SELECT net, a, b FROM edges UNION ALL SELECT net, b, a FROM edges), reach(net, id, place) AS (SELECT net, id, id FROM discs UNION SELECT r.net, r.id, e.b FROM reach r JOIN sides e ON r.net = e.net AND r.place = e.a), "
    "comp AS (SELECT net, id, min(place) AS component FROM reach GROUP BY ALL)"
)


@query(
    f"WITH RECURSIVE {_COMPONENTS}, "
    "s AS (SELECT net, component, count(*) AS n FROM comp GROUP BY ALL), x AS (SELECT c.net, component, count(*) >= 2 AND min(px) <= 10 AND max(px) >= 90 AS spans, count(*) >= 2 AND min(py) <= 10 AND max(py) >= 90 AS spans_y, count(*) >= 2 AND min(pz) <= 10 AND max(pz) >= 90 AS spans_z FROM comp c JOIN discs d USING (net, id) GROUP BY ALL) "
    f"SELECT s.net, sum(s.n)::BIGINT AS n, count(*) AS n_components, max(s.n) AS largest, {r('max(s.n) / sum(s.n)', 'largest_share')}, bool_or(spans) AS spans, bool_or(spans_y) AS spans_y, bool_or(spans_z) AS spans_z FROM s JOIN x USING (net, component) GROUP BY s.net"
)
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.discs(spark, sf_dir)
    return rounded(networks.connectivity(d, networks.linked(d, 11.0), (100.0, 100.0, 100.0)))


@query(
    f"WITH RECURSIVE {_COMPONENTS}, big AS (SELECT net, component FROM (SELECT net, component, row_number() OVER (PARTITION BY net ORDER BY n DESC, component) AS o FROM (SELECT net, component, count(*) AS n FROM comp GROUP BY ALL)) WHERE o = 1), "
    "nrm AS (SELECT p_brand AS net, p_partkey AS id, radians(((p_partkey * 13) % 90)::DOUBLE) AS d, radians(((p_partkey * 29) % 360)::DOUBLE) AS t FROM part), me AS (SELECT net, id, sin(d)*sin(t) AS nx, sin(d)*cos(t) AS ny, cos(d) AS nz FROM comp JOIN big USING (net, component) JOIN nrm USING (net, id)), "
    "ld AS (SELECT net, arg_min(nx, id) AS rx, arg_min(ny, id) AS ry, arg_min(nz, id) AS rz FROM me GROUP BY net), sm AS (SELECT net, avg(nx*g) AS x, avg(ny*g) AS y, avg(nz*g) AS z FROM (SELECT me.*, CASE WHEN nx*rx + ny*ry + nz*rz < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g FROM me JOIN ld USING (net)) GROUP BY net), "
    "un AS (SELECT net, x / sqrt(x*x+y*y+z*z) AS mx, y / sqrt(x*x+y*y+z*z) AS my, z / sqrt(x*x+y*y+z*z) AS mz FROM sm), an AS (SELECT *, 90 - degrees(acos(least(1.0::DOUBLE, abs(mz)))) AS plane_angle FROM un) "
    f"SELECT net, {r('mx', 'mx')}, {r('my', 'my')}, {r('mz', 'mz')}, {r('plane_angle', 'plane_angle')}, CASE WHEN plane_angle < 30 THEN 'high' WHEN plane_angle < 60 THEN 'middle' ELSE 'low' END AS scenario FROM an"
)
def dominant_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.discs(spark, sf_dir)
    found = networks.dominant_direction(d, networks.linked(d, 11.0))
    return rounded(screening.scenario(found, (0.0, 0.0, 1.0), ("high", "middle", "low")))


@query(
    f"WITH {v.DISCS}, m AS (SELECT a.net, avg(pow(a.radius + b.radius, 3)) AS m FROM discs a JOIN discs b ON a.net = b.net AND a.id < b.id GROUP BY a.net), d AS (SELECT net, count(*) / 1e6::DOUBLE AS density FROM discs GROUP BY net) "
    f"SELECT net, {r('density * m * 4 / 3 * pi()', 'excluded')} FROM d JOIN m USING (net)"
)
def excluded_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screening.excluded_volume(v.discs(spark, sf_dir), (100.0, 100.0, 100.0)))


@query()
def percolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of spanning networks drawn from the table of all wells' sets, and the intensities where it is a half, a tenth and nine tenths."""
    sets = aggregates.set_table(v.log(spark, sf_dir).withColumn("site", F.lit(1)), ["site"], v.reference_centers()).drop("site")
    return rounded(networks.percolation(spark, sets, [0.1, 0.2, 0.4, 0.8], 20, (20.0, 20.0, 20.0)))


@query(
    f"WITH {v.LOG}, c AS (SELECT well, floor(depth / 50) * 50 AS x, count(*) AS n FROM obs GROUP BY ALL), k AS (SELECT well, x, sum(n) OVER (PARTITION BY well ORDER BY x) / sum(n) OVER (PARTITION BY well) AS y FROM c), l AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS b FROM k WINDOW w AS (PARTITION BY well ORDER BY x)) "
    f"SELECT well, {r('coalesce(CASE WHEN arg_min(y, x) >= 0.5 THEN min(x) END, min(CASE WHEN b < 0.5 AND y >= 0.5 THEN bx + (0.5 - b) * (x - bx) / (y - b) END), max(x))', 'at')} FROM l GROUP BY well"
)
def curve_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counts = v.log(spark, sf_dir).groupBy("well", (F.floor(F.col("depth") / 50) * 50).cast("double").alias("x")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("well").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return rounded(ordered.crossing(counts.withColumn("y", so_far / F.sum("n").over(Window.partitionBy("well"))), ["well"], "x", "y", 0.5))


# screens


@query(
    f"WITH {v.MEANS} SELECT well, " + ", ".join(r(f"sum(proportion * ({int(a == b)} - m{a} * m{b}))", f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM tables GROUP BY well"
)
def permeability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permeability over that of p32 = 1 in one plane."""
    found = screening.permeability(_tables(spark, sf_dir, "well"), ["well"], p32=12.0, aperture_mm=1000.0)
    return rounded(found)


@query(
    f"WITH {v.MEANS}, g AS (SELECT *, least(abs(dip_dir - 120), 360 - abs(dip_dir - 120)) AS gap FROM tables) SELECT well, set_id, {r('gap', 'strike_gap', 3)}, gap < 60 AND dip > 30 AND dip < 70 AS planar FROM g"
)
def planar_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screening.planar_slides(_tables(spark, sf_dir, "well"), 120.0, 70.0).select("well", "set_id", "strike_gap", "planar"), 3)


@query(
    f"WITH {v.MEANS}, l AS (SELECT a.well, a.set_id AS set_a, b.set_id AS set_b, a.my*b.mz - a.mz*b.my AS x, a.mz*b.mx - a.mx*b.mz AS y, a.mx*b.my - a.my*b.mx AS z FROM tables a JOIN tables b ON a.well = b.well AND a.set_id < b.set_id), u AS (SELECT well, set_a, set_b, x / sqrt(x*x+y*y+z*z) AS x, y / sqrt(x*x+y*y+z*z) AS y, z / sqrt(x*x+y*y+z*z) AS z FROM l WHERE sqrt(x*x+y*y+z*z) > 1e-9), "
    f"t AS (SELECT *, ((degrees(atan2(CASE WHEN z > 0 THEN -x ELSE x END, CASE WHEN z > 0 THEN -y ELSE y END)) % 360) + 360) % 360 AS trend, degrees(asin(least(1.0::DOUBLE, abs(z)))) AS plunge FROM u) SELECT well, set_a, set_b, {r('trend', 'trend', 3)}, {r('plunge', 'plunge', 3)}, least(abs(trend - 120), 360 - abs(trend - 120)) < 60 AND plunge > 30 AND plunge < 70 AS wedge FROM t"
)
def wedge_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screening.wedges(_tables(spark, sf_dir, "well"), ["well"], 120.0, 70.0), 3)


@query(
    f"WITH {v.MEANS}, s AS (SELECT *, (dip_dir - 90 + 360) % 180 AS st FROM tables), h AS (SELECT *, least(((st - 40) % 180 + 180) % 180, 180 - ((st - 40) % 180 + 180) % 180) AS theta FROM s) SELECT well, set_id, {r('theta', 'theta', 3)}, CASE WHEN theta < 30 THEN 'parallel' WHEN theta > 60 THEN 'perpendicular' ELSE 'oblique' END AS stress_class, row_number() OVER (PARTITION BY well ORDER BY theta, set_id)::INT AS stress_rank FROM h"
)
def stress_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screening.stress_ranking(_tables(spark, sf_dir, "well"), ["well"], 40.0).select("well", "set_id", "theta", "stress_class", "stress_rank"), 3)


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical and estimated bands of each well, from its intensity."""
    p = aggregates.intensity(v.log(spark, sf_dir), ["well"])
    return p.select(
        "well", F.lit(1.2).alias("crit_lo"), F.lit(1.8).alias("crit_hi"), (F.col("p32") * 0.2).alias("est_lo"), (F.col("p32") * 0.8).alias("est_hi"),
        F.when(F.col("n") % 2 == 0, "high").otherwise("low").alias("escape"),
    )


_BANDS = f"{v.LOG}, p AS (SELECT well, count(*) AS n, count(*) / (max(depth) - min(depth)) * pi() AS p32 FROM obs GROUP BY well), bands AS (SELECT well, 1.2::DOUBLE AS crit_lo, 1.8::DOUBLE AS crit_hi, p32 * 0.2 AS est_lo, p32 * 0.8 AS est_hi, CASE WHEN n % 2 = 0 THEN 'high' ELSE 'low' END AS escape FROM p)"
_GRADE = "CASE WHEN {eh} < {cl} THEN 'suitable' WHEN {el} > {ch} THEN 'unsuitable' ELSE 'conditional' END"
_DOWN = "CASE WHEN escape = 'high' THEN CASE WHEN {g} = 'suitable' THEN 'conditional' ELSE 'unsuitable' END ELSE {g} END"


@query(f"WITH {_BANDS}, b AS (SELECT *, {_GRADE.format(eh='est_hi', cl='crit_lo', el='est_lo', ch='crit_hi')} AS base_grade FROM bands) SELECT well, base_grade, {_DOWN.format(g='base_grade')} AS grade FROM b")
def disposal_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.disposal_grades(_bands(spark, sf_dir)).select("well", "base_grade", "grade")


@query(
    f"WITH {_BANDS}, g AS (SELECT * FROM bands, (SELECT unnest([2.5::DOUBLE, 3.0::DOUBLE, 3.5::DOUBLE, 4.0::DOUBLE, 4.5::DOUBLE]) AS beta), (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS factor), (SELECT unnest([-1, 0, 1]) AS k_shift)), "
    "s AS (SELECT *, (crit_hi - crit_lo) * (0.1::DOUBLE * sign(beta - 3.5::DOUBLE) + 0.05::DOUBLE * k_shift) AS d FROM g), "
    f"h AS (SELECT *, {_GRADE.format(eh='est_hi', cl='crit_lo', el='est_lo', ch='crit_hi')} AS b0, {_GRADE.format(eh='est_hi * factor', cl='crit_lo + d', el='est_lo * factor', ch='crit_hi + d')} AS b1 FROM s) "
    f"SELECT well, count(*) AS n, count(*) FILTER ({_DOWN.format(g='b0')} <> {_DOWN.format(g='b1')}) AS n_flipped, {r('avg((' + _DOWN.format(g='b0') + ' <> ' + _DOWN.format(g='b1') + ')::INT)', 'flip_rate')} FROM h GROUP BY well"
)
def grade_flip_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = screening.sensitivity(_bands(spark, sf_dir))
    return rounded(grid.groupBy("well").agg(F.count("*").alias("n"), F.count(F.when(F.col("flips"), 1)).alias("n_flipped"), F.avg(F.col("flips").cast("double")).alias("flip_rate")))


@query(
    f"WITH {v.LOG}, s AS (SELECT well, count(*) AS n FROM obs GROUP BY well) SELECT well, n, greatest(2, least(12, floor(n / 11.0::DOUBLE)))::INT AS k FROM s"
)
def recommended_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.log(spark, sf_dir).groupBy("well").agg(F.count("*").alias("n")).withColumn("k", grades.recommended_k(F.col("n")))


@query(f"WITH {v.DISCS} SELECT net, count(*) AS n, {r('sum(radius * radius) * pi() / 1e6', 'p32', 6)} FROM discs GROUP BY net")
def disc_p32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screening.disc_p32(v.discs(spark, sf_dir), (100.0, 100.0, 100.0)), 6)


@query(
    f"WITH {v.POINTS}, c AS (SELECT net, count(*) FILTER (is_obs) AS n_obs, avg(is_obs::INT) AS obs_share FROM pts GROUP BY net), m AS (SELECT *, n_obs / greatest(obs_share, 0.1::DOUBLE) * pi() * 2.5 / 1000 AS p FROM c) SELECT net, n_obs, {r('obs_share', 'obs_share')}, {r('p * 0.2', 'p32_p10')}, {r('p', 'p32_p50')}, {r('p * 5', 'p32_p90')} FROM m"
)
def p32_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screening.p32_interval(v.points(spark, sf_dir), (10.0, 10.0, 10.0)))


@query(
    f"WITH {v.LOG}, g AS (SELECT well, depth - lag(depth) OVER (PARTITION BY well ORDER BY depth, row_id) AS gap FROM obs) SELECT well, count(*) AS n, {r('avg(gap)', 'spacing')}, {r('1 / avg(gap)', 'p10')}, {r('pi() / avg(gap)', 'p32')} FROM g WHERE gap > 0 GROUP BY well"
)
def p32_from_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    gap = F.col("depth") - F.lag("depth").over(Window.partitionBy("well").orderBy("depth", "row_id"))
    return rounded(screening.p32_from_gaps(v.log(spark, sf_dir).withColumn("gap", gap), ["well"]))


@query(
    f"WITH {v.MEANS}, e AS (SELECT well, set_id, round(proportion / sum(proportion) OVER (PARTITION BY well) * 100, 9) AS e FROM tables), f AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY round(e - floor(e), 9) DESC, set_id) AS k, 100 - sum(floor(e)) OVER (PARTITION BY well) AS rest FROM e) SELECT well, set_id, (floor(e) + CASE WHEN k <= rest THEN 1 ELSE 0 END)::INT AS share FROM f"
)
def apportioned_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred discs dealt to each well's sets by their proportions."""
    return screening.apportioned(_tables(spark, sf_dir, "well"), ["well"], 100).select("well", "set_id", "share")


@query(f"WITH {_BANDS}, g AS (SELECT well, est_lo, est_hi, unnest(range(0, 10)) AS i FROM bands) SELECT DISTINCT well, {r('est_lo + (est_hi - est_lo) * i / 9', 'x', 3)} FROM g")
def fine_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.fine_grid(_bands(spark, sf_dir), ["well"], "est_lo", "est_hi")


from . import intrinsic, surveyed  # noqa: E402, F401  register their queries
