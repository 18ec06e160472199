"""Engineering screens over set tables: permeability, slopes, stress, disposal grades. Set tables are small."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles, grades


def permeability(table: DataFrame, by: list[str], p32: float, aperture_mm: float = 0.1) -> DataFrame:
    """By group: the six parts kxx ... kzz of the sum of p32 * b^3 / 12 * (I - n n^T) over sets, b in metres."""
    w = F.col("proportion") * F.lit(p32 * (aperture_mm / 1000) ** 3 / 12)
    n = dict(zip("xyz", angles.vector("m")))
    return table.groupBy(*by).agg(*(F.sum(w * ((1.0 if a == b else 0.0) - n[a] * n[b])).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))


def planar_slides(table: DataFrame, slope_trend: float, slope_dip: float, friction: float = 30.0) -> DataFrame:
    """table (dip, dip_dir) with strike_gap and planar: whether a plane may slide out of a slope.

    It does if it strikes near the slope's face and dips more steeply than friction and less than the slope.
    """
    gap = angles.axial_difference(F.col("dip_dir"), F.lit(slope_trend), 360)
    return table.withColumn("strike_gap", gap).withColumn("planar", (gap < 90 - friction) & (F.col("dip") > friction) & (F.col("dip") < slope_dip))


def wedges(table: DataFrame, by: list[str], slope_trend: float, slope_dip: float, friction: float = 30.0) -> DataFrame:
    """(by, set_a, set_b, trend, plunge, wedge) for every two sets of a group: their line of intersection."""
    a = table.select(*by, F.col("set_id").alias("set_a"), *(F.col(f"m{c}").alias(f"a{c}") for c in "xyz"))
    b = table.select(*by, F.col("set_id").alias("set_b"), *(F.col(f"m{c}").alias(f"b{c}") for c in "xyz"))
    pairs = a.join(b, by).filter("set_a < set_b")
    line = angles.cross(angles.vector("a"), angles.vector("b"))
    named = pairs.withColumns(dict(zip(("__x", "__y", "__z"), line))).filter(angles.length(angles.vector("__")) > 1e-9)
    x, y, z = angles.unit(angles.vector("__"), 0.0)
    down = F.when(z > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    trend = angles.wrap(F.degrees(F.atan2(x * down, y * down)), 360)
    plunge = F.degrees(F.asin(F.least(F.lit(1.0), F.abs(z))))
    out = named.withColumn("trend", trend).withColumn("plunge", plunge)
    gap = angles.axial_difference(F.col("trend"), F.lit(slope_trend), 360)
    return out.withColumn("wedge", (gap < 90 - friction) & (F.col("plunge") > friction) & (F.col("plunge") < slope_dip)).select(*by, "set_a", "set_b", "trend", "plunge", "wedge")


def stress_ranking(table: DataFrame, by: list[str], shmax: float) -> DataFrame:
    """table (strike) with theta, the acute angle of strike to the largest horizontal stress, a class and a rank by closeness."""
    theta = angles.axial_difference(F.col("strike"), F.lit(shmax))
    kind = F.when(F.col("theta") < 30, "parallel").when(F.col("theta") > 60, "perpendicular").otherwise("oblique")
    return table.withColumn("theta", theta).withColumn("stress_class", kind).withColumn("stress_rank", F.row_number().over(Window.partitionBy(*by).orderBy("theta", "set_id")))


def scenario(direction: DataFrame, axis: tuple[float, float, float], names: tuple[str, str, str]) -> DataFrame:
    """direction (mx, my, mz) with plane_angle to an axis and its class; no direction, no angle."""
    m = angles.vector("m")
    angle = F.when(angles.length(m) > 1e-6, angles.plane_axis_angle(m, angles.literal(axis)))
    return direction.withColumn("plane_angle", angle).withColumn("scenario", grades.scenario_class(F.col("plane_angle"), names))


def disposal_grades(bands: DataFrame) -> DataFrame:
    """bands (crit_lo, crit_hi, est_lo, est_hi, escape) with base_grade and grade after the escape penalty."""
    base = grades.overlap_grade(F.col("crit_lo"), F.col("crit_hi"), F.col("est_lo"), F.col("est_hi"))
    return bands.withColumn("base_grade", base).withColumn("grade", grades.penalized(F.col("base_grade"), F.col("escape")))


#: Fixed values of the sensitivity grid: size-law exponents, factors on the estimate, changes of the number of sets.
BETAS = (2.5, 3.0, 3.5, 4.0, 4.5)
FACTORS = (0.5, 1.0, 2.0)
K_SHIFTS = (-1, 0, 1)


def sensitivity(bands: DataFrame) -> DataFrame:
    """bands, each under every combination of the grid, with beta, factor, k_shift, grade and whether it `flips` the base one.

    An exponent above 3.5 moves the critical band up by a tenth of its width and one below it down by as much; a
    further set moves it up by a twentieth, one set fewer down.
    """
    grid = F.explode(F.array(*(F.struct(F.lit(b).alias("beta"), F.lit(f).alias("factor"), F.lit(k).alias("k_shift")) for b in BETAS for f in FACTORS for k in K_SHIFTS)))
    rows = bands.withColumn("__g", grid).withColumns({c: F.col(f"__g.{c}") for c in ("beta", "factor", "k_shift")}).drop("__g")
    width = F.col("crit_hi") - F.col("crit_lo")
    shift = width * (0.1 * F.signum(F.col("beta") - 3.5) + 0.05 * F.col("k_shift"))
    moved = rows.withColumns({"__lo": F.col("crit_lo") + shift, "__hi": F.col("crit_hi") + shift})
    base = grades.penalized(grades.overlap_grade(F.col("crit_lo"), F.col("crit_hi"), F.col("est_lo"), F.col("est_hi")), F.col("escape"))
    now = grades.penalized(grades.overlap_grade(F.col("__lo"), F.col("__hi"), F.col("est_lo") * F.col("factor"), F.col("est_hi") * F.col("factor")), F.col("escape"))
    return moved.withColumn("grade", now).withColumn("flips", now != base).drop("__lo", "__hi")


def excluded_volume(discs: DataFrame, domain: tuple[float, float, float]) -> DataFrame:
    """(net, excluded): density times the mean (4/3) pi (ri + rj)^3 over all pairs of a net's discs; a net of one disc has none.

    The sum over pairs follows from sums of powers: over i < j, (ri + rj)^3 adds up to n * S3 + 3 * S1 * S2 - 4 * S3.
    """
    r = F.col("radius")
    sums = discs.groupBy("net").agg(F.count("*").cast("double").alias("n"), F.sum(r).alias("s1"), F.sum(r * r).alias("s2"), F.sum(r * r * r).alias("s3")).filter("n > 1")
    n = F.col("n")
    mean = (n * F.col("s3") + 3 * F.col("s1") * F.col("s2") - 4 * F.col("s3")) / (n * (n - 1) / 2) * (4 / 3 * math.pi)
    return sums.select("net", (n / F.lit(domain[0] * domain[1] * domain[2]) * mean).alias("excluded"))


def set_pairs(table: DataFrame, by: list[str]) -> DataFrame:
    """(by, set_a, set_b, angle) between every two sets of a group."""
    a = table.select(*by, F.col("set_id").alias("set_a"), *(F.col(f"m{c}").alias(f"a{c}") for c in "xyz"))
    b = table.select(*by, F.col("set_id").alias("set_b"), *(F.col(f"m{c}").alias(f"b{c}") for c in "xyz"))
    return a.join(b, by).filter("set_a < set_b").select(*by, "set_a", "set_b", angles.angle(angles.vector("a"), angles.vector("b")).alias("angle"))


def near_duplicate_remarks(table: DataFrame, by: list[str], below: float = 15.0) -> DataFrame:
    """(by, set_id, remark): for each set, the sets closer than `below` degrees, in order, joined by commas."""
    near = set_pairs(table, by).filter(F.col("angle") < below)
    both = near.select(*by, F.col("set_a").alias("set_id"), F.col("set_b").alias("other")).unionByName(near.select(*by, F.col("set_b").alias("set_id"), F.col("set_a").alias("other")))
    return both.groupBy(*by, "set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("other")), lambda x: x.cast("string")), ",").alias("remark"))



def disc_p32(discs: DataFrame, domain: tuple[float, float, float]) -> DataFrame:
    """(net, n, p32): the discs' area over the domain's volume."""
    volume = domain[0] * domain[1] * domain[2]
    return discs.groupBy("net").agg(F.count("*").alias("n"), (F.sum(F.col("radius") * F.col("radius")) * (math.pi / volume)).alias("p32"))


def p32_interval(rows: DataFrame, domain: tuple[float, float, float], r_min: float = 0.5, r_max: float = 5.0) -> DataFrame:
    """(net, n_obs, obs_share, p32_p10, p32_p50, p32_p90): an order of magnitude from a count of rows (is_obs) in a domain.

    Sizes are not known: an area of pi * r_min * r_max stands for each. The count seen is scaled up by the share
    observed, a tenth at least; the band is a fifth to five times the middle.
    """
    counts = rows.groupBy("net").agg(F.count(F.when(F.col("is_obs"), 1)).alias("n_obs"), F.avg(F.col("is_obs").cast("double")).alias("obs_share"))
    middle = F.col("n_obs") / F.greatest(F.col("obs_share"), F.lit(0.1)) * F.lit(math.pi * r_min * r_max / (domain[0] * domain[1] * domain[2]))
    return counts.withColumn("p32_p50", middle).select("net", "n_obs", "obs_share", (F.col("p32_p50") * 0.2).alias("p32_p10"), "p32_p50", (F.col("p32_p50") * 5.0).alias("p32_p90"))


def p32_from_gaps(gaps: DataFrame, by: list[str], radius: float = 1.0) -> DataFrame:
    """(by, n, spacing, p10, p32): p10 is one over the mean positive gap, p32 that times a disc's area; no gap, no figure."""
    found = gaps.filter("gap > 0").groupBy(*by).agg(F.count("*").alias("n"), F.avg("gap").alias("spacing"))
    return found.withColumn("p10", 1 / F.col("spacing")).withColumn("p32", F.col("p10") * F.lit(math.pi * radius * radius))


def apportioned(table: DataFrame, by: list[str], total: int) -> DataFrame:
    """table (set_id, proportion) with `share` int: whole numbers that add up to total in each group.

    Each set has the floor of its part; what is left goes to the largest remainders, the smaller set_id of equals.
    """
    group = Window.partitionBy(*by)
    exact = F.col("proportion") / F.sum("proportion").over(group) * total
    # parts that are whole but for rounding count as whole
    parts = table.withColumn("__e", F.round(exact, 9)).withColumn("__f", F.floor("__e"))
    order = F.row_number().over(group.orderBy(F.desc(F.round(F.col("__e") - F.col("__f"), 9)), "set_id"))
    return parts.withColumn("share", (F.col("__f") + F.when(order <= total - F.sum("__f").over(group), 1).otherwise(0)).cast("int")).drop("__e", "__f")


def fine_grid(bands: DataFrame, by: list[str], lo: str, hi: str, steps: int = 9, digits: int = 3) -> DataFrame:
    """(by, x): steps + 1 even places from lo to hi, rounded, each once."""
    at = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    placed = bands.select(*by, lo, hi, at.alias("__i"))
    return placed.select(*by, F.round(F.col(lo) + (F.col(hi) - F.col(lo)) * F.col("__i") / steps, digits).alias("x")).distinct()
