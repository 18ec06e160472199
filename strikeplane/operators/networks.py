"""Discrete fracture networks: discs drawn by Spark, their graph, components, and percolation.

Every realization is one value of `net`; all realizations of a grid of intensities and seeds run as one job, so
the work spreads over the cluster by net and by grid cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import angles
from .neighbours import disc_edges
from .components import components as stars
from .tables import written


def uniform(*keys: Column) -> Column:
    """A number strictly between 0 and 1 that follows from the keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))


def power_law_radius(u: Column, beta: float, r_min: float, r_max: float) -> Column:
    """Inverse of the cumulative truncated power law of exponent beta; log-uniform at 1."""
    if not math.isfinite(beta):
        raise ValueError("the exponent of a size law must be finite")
    if abs(beta - 1) < 1e-9:
        return F.lit(r_min) * F.pow(F.lit(r_max / r_min), u)
    a, b = r_min ** (1 - beta), r_max ** (1 - beta)
    return F.pow(F.lit(a) + u * (b - a), F.lit(1 / (1 - beta)))


def mean_square_radius(beta: float, r_min: float, r_max: float) -> float:
    """E[r^2] of the truncated power law."""
    def part(k: float) -> float:
        return math.log(r_max / r_min) if abs(k) < 1e-9 else (r_max**k - r_min**k) / k

    return part(3 - beta) / part(1 - beta)


def fisher_direction(u: Column, v: Column, kappa: Column, mean: angles.Vector) -> angles.Vector:
    """A direction around mean of concentration kappa, from two uniform numbers; kappa near 0 is isotropic."""
    w = F.when(kappa < 1e-8, 2 * u - 1).otherwise(1 + F.log(u + (1 - u) * F.exp(-2 * kappa)) / kappa)
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w))
    s, a = F.sqrt(1 - w * w), 2 * math.pi * v
    helper = tuple(F.when(F.abs(mean[2]) < 0.9, F.lit(x)).otherwise(F.lit(y)) for x, y in ((0.0, 1.0), (0.0, 0.0), (1.0, 0.0)))
    e1 = angles.unit(angles.cross(helper, mean), 1e-12)
    e2 = angles.cross(mean, e1)
    return tuple(w * mean[i] + s * (F.cos(a) * e1[i] + F.sin(a) * e2[i]) for i in range(3))  # type: ignore[return-value]


def dealt(n: Column, shares: list[float], pick: Callable[[Column], Column]) -> Column:
    """Array of how many of n discs each set has: its share, rounded to the even one of halves.

    While they are too few, a set that pick (a number below 1 for each missing disc) draws has one more; while they are
    too many, the first of the largest has one less.
    """
    rounded = F.array(*(F.bround(n * F.lit(float(share))).cast("long") for share in shares))
    off = n - F.aggregate(rounded, F.lit(0).cast("long"), lambda a, x: a + x)

    def changed(counts: Column, j: Column) -> Column:
        at = F.when(off > 0, F.floor(pick(j) * len(shares)).cast("int")).otherwise((F.array_position(counts, F.array_max(counts)) - 1).cast("int"))
        return F.transform(counts, lambda c, i: c + F.when(i == at, F.signum(off).cast("long")).otherwise(F.lit(0).cast("long")))

    steps = F.when(off == 0, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(F.abs(off), F.lit(1).cast("long"))))
    return F.aggregate(steps, rounded, changed)


def generate(spark: SparkSession, sets: DataFrame, runs: DataFrame, domain: tuple[float, float, float], beta: float = 3.5, r_min: float = 0.5, r_max: float = 2.5, largest_n: int = 20_000, least_n: int = 0) -> DataFrame:
    """Discs (net, p32, seed, id, px, py, pz, nx, ny, nz, radius, set_id) of realizations runs (net, p32, seed).

    sets is a set table (set_id, mx, my, mz, kappa, proportion), few rows. A run has p32 * volume / (pi * E[r^2])
    discs of uniform centers, least_n or more where p32 is above 0, and each set its share of them; one of more than
    largest_n fails. Every number follows from run, disc and purpose.
    """
    volume = domain[0] * domain[1] * domain[2]
    per = volume / (math.pi * mean_square_radius(beta, r_min, r_max))
    wanted = F.when(F.col("p32") > 0, F.greatest(F.lit(float(least_n)), F.bround(F.col("p32") * per))).otherwise(0.0)
    n = F.when(wanted <= largest_n, wanted.cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"a network may have {largest_n} discs, not "), wanted.cast("string"))).cast("int"))
    table = sets.select("set_id", "proportion", "mx", "my", "mz", "kappa").orderBy("set_id").collect()  # a few rows by its contract
    if not table:
        raise ValueError("a network needs a set table with at least one set")
    listed = F.array(*(F.struct(F.lit(int(r["set_id"])).alias("set_id"), *(F.lit(float(r[c])).alias(c) for c in ("mx", "my", "mz", "kappa"))) for r in table))
    counts = dealt(F.col("n").cast("long"), [r["proportion"] for r in table], lambda j: uniform(F.col("seed"), F.col("p32"), j, F.lit("more")))
    sized = runs.withColumn("n", n).filter("n > 0").withColumn("counts", counts)
    ids = sized.withColumn("id", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    key = lambda what: uniform(F.col("seed"), F.col("p32"), F.col("id"), F.lit(what))
    # discs of a set follow those of the set before
    chosen = F.aggregate(
        F.col("counts"),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at")),
        lambda s, c: F.struct((s["sum"] + c).alias("sum"), F.when(F.col("id") >= s["sum"] + c, s["at"] + 1).otherwise(s["at"]).alias("at")),
        lambda s: s["at"],
    )
    placed = ids.withColumn("s", F.get(listed, chosen)).drop("counts")
    mean = tuple(F.col(f"s.m{c}") for c in "xyz")
    direction = fisher_direction(key("tilt"), key("turn"), F.col("s.kappa"), mean)
    return placed.select(
        "net", "p32", "seed", F.col("id").cast("long").alias("id"),
        *((key(c) * d).alias(f"p{c}") for c, d in zip("xyz", domain)),
        *(x.alias(f"n{c}") for x, c in zip(direction, "xyz")),
        power_law_radius(key("size"), beta, r_min, r_max).alias("radius"), F.col("s.set_id").alias("set_id"),
    )


def components(discs: DataFrame, edges: DataFrame) -> DataFrame:
    """(net, id, component): the smallest id that chains of edges reach within a net; a disc without edges is its own.

    Rounds run over the edges alone.
    """
    node = lambda c: F.struct("net", F.col(c).alias("id"))
    found = stars(edges.select(node("a").alias("a"), node("b").alias("b")))
    labels = found.select(F.col("node.net").alias("net"), F.col("node.id").alias("id"), F.col("label.id").alias("component"))
    return discs.select("net", "id").join(labels, ["net", "id"], "left").select("net", "id", F.coalesce("component", "id").alias("component"))


def linked(discs: DataFrame, largest: float) -> DataFrame:
    """components() of discs (net, id, px, py, pz, radius) by their overlaps, as disc_edges() finds them, without the table of all overlaps.

    Discs at one place overlap and the widest of them reaches all that the others reach, so a place is one disc. Discs
    of radius r or more whose places share a cell of diagonal below 2 r overlap too: places of like radius form clumps
    by such cells, and only which clumps meet is kept. What is shuffled so grows with places and with pairs of clumps,
    of which a volume holds so many, not with pairs of discs. Discs without radius (0 or less) stay alone.
    """
    keys = ["net", "px", "py", "pz", "__own"]
    apart = F.when(F.col("radius") > 0, F.lit("")).otherwise(F.col("id").cast("string"))
    flat = discs.select("net", "id", "px", "py", "pz", "radius", apart.alias("__own"))
    places = flat.dropna(subset=["net", "px", "py", "pz", "radius"]).groupBy(*keys).agg(F.min("id").alias("id"), F.max("radius").alias("radius"))
    least = F.pow(F.lit(2.0), F.floor(F.log2("radius")))
    side = least * (2 / math.sqrt(3) * (1 - 1e-6))  # floors of places up to 2**30 cells away are sure to this
    # a logarithm may round up to the next class; places too far out for such cells are clumps of their own
    fine = (F.col("radius") > 0) & (least <= F.col("radius"))
    for c in ("px", "py", "pz"):
        fine &= F.abs(F.col(c)) < side * 2.0**30
    alone = F.when(fine, F.lit("")).otherwise(F.col("id").cast("string"))
    clump = ["net", "__least", "__x", "__y", "__z", "__alone"]
    celled = places.withColumns({"__least": F.when(fine, least).otherwise(0.0), "__alone": alone} | {f"__{c}": F.when(fine, F.floor(F.col(f"p{c}") / side)).otherwise(F.lit(0)) for c in "xyz"})
    placed = written(celled.withColumn("node", F.min("id").over(Window.partitionBy(*clump))).select(*keys, "id", "radius", "node"), "disc-places")
    name = lambda c: F.struct("node", "id").alias(c)
    met = disc_edges(placed.select("net", name("id"), "px", "py", "pz", "radius"), largest)
    pairs = met.select("net", F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).filter("a < b").distinct()
    nodes = placed.select("net", F.col("node").alias("id")).distinct()
    labels = written(components(nodes, pairs), "disc-clumps")
    of_place = placed.select(*keys, "node").join(labels.withColumnRenamed("id", "node"), ["net", "node"])
    return flat.join(of_place, keys, "left").select("net", "id", F.coalesce("component", "id").alias("component"))


def component_sizes(discs: DataFrame, labels: DataFrame, domain: tuple[float, float, float]) -> DataFrame:
    """(net, component, n, spans, spans_y, spans_z): a component spans an axis if it has two discs or more and centers in both outer tenths of it."""
    both = discs.join(labels, ["net", "id"])
    spans = [
        ((F.count("*") >= 2) & (F.min(c) <= 0.1 * size) & (F.max(c) >= 0.9 * size)).alias(name)
        for c, size, name in zip(("px", "py", "pz"), domain, ("spans", "spans_y", "spans_z"))
    ]
    return both.groupBy("net", "component").agg(F.count("*").alias("n"), *spans)


def connectivity(discs: DataFrame, labels: DataFrame, domain: tuple[float, float, float]) -> DataFrame:
    """(net, n, n_components, largest, largest_share, spans, spans_y, spans_z) of each realization; spans is along x."""
    return component_sizes(discs, labels, domain).groupBy("net").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_components"),
        F.max("n").alias("largest"),
        (F.max("n") / F.sum("n")).alias("largest_share"),
        *(F.max(c).alias(c) for c in ("spans", "spans_y", "spans_z")),
    )


def dominant_direction(discs: DataFrame, labels: DataFrame) -> DataFrame:
    """(net, mx, my, mz): the mean normal of each net's largest component, turned to that of its first disc."""
    sizes = labels.groupBy("net", "component").agg(F.count("*").alias("n")).groupBy("net").agg(F.max_by("component", F.struct("n", (-F.col("component")).alias("k"))).alias("component"))
    members = discs.join(labels.join(sizes, ["net", "component"], "left_semi"), ["net", "id"])
    first = members.groupBy("net").agg(F.min_by(F.struct("nx", "ny", "nz"), "id").alias("r"))
    turned = members.join(first, "net").withColumns({f"r{c}": F.col("r")[f"n{c}"] for c in "xyz"})
    side = angles.aligned(angles.vector(), angles.vector("r"))
    sums = turned.groupBy("net").agg(*(F.avg(s).alias(c) for s, c in zip(side, ("sx", "sy", "sz"))))
    return sums.select("net", *(u.alias(c) for u, c in zip(angles.unit(angles.vector("s"), 1e-12), ("mx", "my", "mz"))))


def threshold(curve: Column, target: float) -> Column:
    """Where a curve, an array of struct(x, y) by rising x, first goes from target or below to target or above, by linear interpolation.

    One that stays below gives its last x, one that stays above its first, and one that only falls through target the
    x in its middle.
    """
    y = F.transform(curve, lambda p: p["y"])
    steps = F.zip_with(F.slice(curve, F.lit(1), F.greatest(F.size(curve) - 1, F.lit(0))), F.slice(curve, 2, F.size(curve)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    up = F.get(F.filter(steps, lambda s: (s["a"]["y"] <= target) & (s["b"]["y"] >= target)), F.lit(0))
    at = up["a"]["x"] + (target - up["a"]["y"]) / (up["b"]["y"] - up["a"]["y"] + 1e-12) * (up["b"]["x"] - up["a"]["x"])
    x = lambda i: F.get(curve, i)["x"]
    return F.when(F.array_max(y) < target, x(F.size(curve) - 1)).when(F.array_min(y) > target, x(F.lit(0))).otherwise(F.coalesce(at, x(F.floor(F.size(curve) / 2).cast("int"))))


#: Columns of the critical intensities and the shares of spanning networks they stand for.
CRITICAL = {"p32_crit": 0.5, "p32_crit_lower": 0.1, "p32_crit_upper": 0.9}


def percolation(
    spark: SparkSession, sets: DataFrame, intensities: list[float], seeds: int, domain: tuple[float, float, float], beta: float = 3.5, r_min: float = 0.5, r_max: float = 2.5, axis: int = 0, periodic: bool = False, least_n: int = 200,
) -> DataFrame:
    """(p32, p_conn, mean_share, p32_crit, p32_crit_lower, p32_crit_upper): the percolation curve and its thresholds.

    p_conn is the share of seeds whose network spans the domain along an axis, for each intensity; the critical
    intensities, the same in every row, are where it reaches 0.5, 0.1 and 0.9, as threshold() finds them. A network has
    least_n discs or more. With periodic, discs also meet through the walls.
    """
    runs = spark.createDataFrame([(i * seeds + s, float(p), s) for i, p in enumerate(sorted(intensities)) for s in range(seeds)], "net long, p32 double, seed int")
    discs = written(generate(spark, sets, runs, domain, beta, r_min, r_max, least_n=least_n), "discs")
    labels = components(discs, disc_edges(discs, r_max, domain)) if periodic else linked(discs, r_max)
    found = connectivity(discs, labels, domain)
    spans = F.coalesce(F.col(("spans", "spans_y", "spans_z")[axis]), F.lit(False)).cast("double")
    curve = written(runs.join(found, "net", "left").groupBy("p32").agg(F.avg(spans).alias("p_conn"), F.avg(F.coalesce("largest_share", F.lit(0.0))).alias("mean_share")), "percolation")
    listed = curve.agg(F.array_sort(F.collect_list(F.struct(F.col("p32").alias("x"), F.col("p_conn").alias("y")))).alias("curve"))
    told = listed.select(*(threshold(F.col("curve"), at).alias(name) for name, at in CRITICAL.items()))
    return curve.crossJoin(F.broadcast(told))
