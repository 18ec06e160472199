"""Set tables corrected for the borehole's direction at each row: axes from surveys, gated weights, mixtures and weighted k-means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles
from .aggregates import Center, eigen
from .clusters import em_mixture, labelled, lloyd, starting_centers
from .ordered import tangents, trajectory
from .tables import written


def well_paths(stations: DataFrame, by: str = "well", least_span: float = 1e-3, straight: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Wells (by, axis_source, ux, uy, uz, md0, step, last) and stations (by, md, tx, ty, tz, next_md, first) of surveys (md, hazi, hdev).

    A well whose path is straight, its second singular value under `straight` of the first, has one axis for all its
    rows (`trajectory_straight`); another one the path's tangent at each station (`trajectory_tangent`). A well of one
    station, or that goes nowhere, has no axis (`unavailable`).
    """
    path = written(tangents(trajectory(stations, [by]), [by]), "paths")
    names = ("east", "north", "up")
    moments = [F.covar_pop(names[i], names[j]).alias(f"s{'xyz'[i]}{'xyz'[j]}") for i in range(3) for j in range(i, 3)]
    span = F.sqrt(sum(((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in names), F.lit(0.0)))
    sums = written(path.groupBy(by).agg(F.count("*").alias("n"), span.alias("span"), F.min("md").alias("md0"), F.max("md").alias("md1"), *moments), "path-moments")
    axes = eigen(sums.select(by, *(f"s{k}" for k in ("xx", "xy", "xz", "yy", "yz", "zz"))), [by]).select(by, "l1", "l2", *(F.col(f"e1{c}").alias(f"u{c}") for c in "xyz"))
    none = (F.col("n") < 2) | (F.col("span") < least_span)
    source = F.when(none, "unavailable").when(F.greatest(F.col("l2"), F.lit(0.0)) < straight * straight * F.col("l1"), "trajectory_straight").otherwise("trajectory_tangent")
    step = F.greatest((F.col("md1") - F.col("md0")) / F.col("n"), F.lit(1e-9))
    wells = sums.join(axes, by).select(by, source.alias("axis_source"), "ux", "uy", "uz", "md0", step.alias("step"), F.floor((F.col("md1") - F.col("md0")) / step).alias("last"))
    w = Window.partitionBy(by).orderBy("md", "row_id")
    return wells, path.select(by, "md", "tx", "ty", "tz", F.lead("md").over(w).alias("next_md"), F.lag("md").over(w).isNull().alias("first"))


def row_axes(log: DataFrame, stations: DataFrame | None = None, axis: Center | None = None, by: str = "well") -> DataFrame:
    """log (by, depth) with the borehole's direction at each row, ax, ay, az, and axis_source.

    A given axis (`explicit`) goes before the survey. A row takes the tangent at the last station that is not deeper,
    or at the first: log rows and survey intervals meet in depth cells, as long as a well's stations lie apart on
    average, so a long well is spread over its cells and has at most twice its stations of them. Rows without a depth,
    and wells without a survey, have no axis.
    """
    if axis is not None:
        u = angles.unit(angles.literal(axis), 0.0)
        return log.withColumns(dict(zip(("ax", "ay", "az"), u)) | {"axis_source": F.lit("explicit")})
    if stations is None:
        return log.withColumns({c: F.lit(None).cast("double") for c in ("ax", "ay", "az")} | {"axis_source": F.lit("unavailable")})
    wells, marks = well_paths(stations, by)
    wells = written(wells, "well-axes")
    cell = lambda d: F.greatest(F.lit(-1), F.least(F.col("last") + 1, F.floor((d - F.col("md0")) / F.col("step"))))
    begin, end = F.when(F.col("first"), F.lit(-1)).otherwise(cell(F.col("md"))), F.coalesce(cell(F.col("next_md")), F.col("last") + 1)
    low = F.when(F.col("first"), F.lit(float("-inf"))).otherwise(F.col("md"))
    spans = marks.join(wells.filter("axis_source = 'trajectory_tangent'"), by).select(by, F.explode(F.sequence(begin, end)).alias("__cell"), low.alias("__low"), F.coalesce("next_md", F.lit(float("inf"))).alias("__high"), "tx", "ty", "tz")
    told = log.join(wells, by, "left").withColumn("__cell", cell(F.col("depth")))
    inside = (told["depth"] >= spans["__low"]) & (told["depth"] < spans["__high"])
    met = told.join(spans, (told[by] == spans[by]) & (told["__cell"] == spans["__cell"]) & inside, "left").drop(spans[by]).drop("__cell")
    straight = F.col("axis_source") == "trajectory_straight"
    found = met.withColumns({f"a{c}": F.when(straight, F.col(f"u{c}")).otherwise(F.col(f"t{c}")) for c in "xyz"})
    source = F.when(F.col("ax").isNull(), "unavailable").otherwise(F.col("axis_source"))
    return found.withColumn("axis_source", source).drop("ux", "uy", "uz", "tx", "ty", "tz", "md0", "step", "last", "__low", "__high")


def gated_weights(rows: DataFrame, by: str = "well", least_share: float = 0.5, lo: float = 0.1, hi: float = 5.0) -> DataFrame:
    """rows of row_axes() with w, and for their group ess_share, dev_from_z, weights_used and reason.

    A raw weight is one over the cosine between normal and axis; w is that over the group's mean, held between lo and
    hi. Where the effective number of rows is under least_share of them (`terzaghi_ess_below_gate`), or any row has no
    axis (`no_well_axis`), the whole group goes unweighted, w 1, and says so; ess_share keeps what was measured.
    """
    raw = angles.raw_terzaghi(angles.vector(), angles.vector("a"))
    mean = rows.groupBy(by).agg(F.avg(raw).alias("__mean"), F.count(F.when(F.col("ax").isNull(), 1)).alias("__bare"))
    held = F.least(F.lit(hi), F.greatest(F.lit(lo), raw / F.col("__mean")))
    weighed = written(rows.join(mean, by).withColumn("w", held).drop("__mean"), "weighed")
    off = angles.angle(angles.vector("a"), angles.literal((0.0, 0.0, 1.0)))
    sums = weighed.groupBy(by).agg((F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w")) / F.count("*")).alias("ess_share"), F.max(off).alias("dev_from_z"), F.max("__bare").alias("__none"))
    reason = F.when(F.col("__none") > 0, "no_well_axis").when(F.col("ess_share") < least_share, "terzaghi_ess_below_gate")
    gate = written(sums.withColumn("reason", reason).withColumn("weights_used", F.when(F.col("reason").isNull(), "terzaghi").otherwise("none")), "gates")
    told = gate.withColumn("ess_share", F.when(F.col("__none") == 0, F.col("ess_share"))).drop("__none")
    return weighed.drop("__bare").join(told, by).withColumn("w", F.when(F.col("weights_used") == "terzaghi", F.col("w")).otherwise(F.lit(1.0)))


def decode(weighed: DataFrame, k: int, by: str = "well", rounds: int = 20, id_col: str = "row_id") -> DataFrame:
    """The set table of each group of gated_weights(), by a weighted axial mixture: one row for each set, by falling share.

    (by, set_id, share, n_points, n_eff, ess, kappa, dip, dip_dir, weights_used, reason, ess_share, axis_source,
    dev_from_z). n_points counts rows by their nearest axis, n_eff is the effective number behind them.
    """
    rows = written(weighed.select(F.col(by).alias("net"), F.col(id_col).alias("id"), "nx", "ny", "nz", "w"), "decode-rows")
    model = em_mixture(rows, starting_centers(rows, k), rounds, "w")
    place = (F.row_number().over(Window.partitionBy("net").orderBy(F.desc("share"), "k")) - 1).alias("set_id")
    table = written(model.select("net", place, "share", "ess", "kappa", "cx", "cy", "cz"), "decoded")
    axes = table.groupBy("net").agg(F.transform(F.array_sort(F.collect_list(F.struct("set_id", "cx", "cy", "cz"))), lambda c: F.struct(c["cx"].alias("x"), c["cy"].alias("y"), c["cz"].alias("z"))).alias("centers"))
    sizes = labelled(rows, axes).groupBy("net", "set_id").agg(F.count("*").alias("n_points"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("n_eff"))
    notes = weighed.groupBy(by).agg(*(F.first(c).alias(c) for c in ("weights_used", "reason", "ess_share", "dev_from_z")), F.max("axis_source").alias("axis_source")).withColumnRenamed(by, "net")
    c = angles.vector("c")
    out = table.join(sizes, ["net", "set_id"], "left").join(notes, "net")
    return out.select(
        F.col("net").alias(by), "set_id", "share", F.coalesce("n_points", F.lit(0).cast("long")).alias("n_points"), F.coalesce("n_eff", F.lit(0.0)).alias("n_eff"), "ess", "kappa",
        angles.dip(c).alias("dip"), angles.dip_direction(c).alias("dip_dir"), "weights_used", "reason", "ess_share", "axis_source", "dev_from_z",
    )


def reassigned(placed: DataFrame, by: str = "well", rounds: int = 40) -> DataFrame:
    """placed (by, set_id, w, normals) with new_set_id: weighted k-means from the weighted means of the sets it has.

    Rounds go on until no center moves, `rounds` at most. Sets keep their numbers; a set without rows has none to give.
    """
    net = placed.withColumnRenamed(by, "net")
    first = net.groupBy("net", "set_id").agg(F.min(F.struct("nx", "ny", "nz")).alias("r"))
    side = angles.aligned(angles.vector(), tuple(F.col("r")[f"n{c}"] for c in "xyz"))
    sums = net.join(first, ["net", "set_id"]).groupBy("net", "set_id").agg(*(F.sum(s * F.col("w")).alias(c) for s, c in zip(side, ("sx", "sy", "sz"))))
    means = sums.select("net", "set_id", F.struct(*(u.alias(c) for u, c in zip(angles.unit(angles.vector("s"), 0.0), "xyz"))).alias("c"))
    ordered = means.groupBy("net").agg(F.array_sort(F.collect_list(F.struct("set_id", "c"))).alias("a"))
    ordered = written(ordered, "reassign-sets")
    centers = lloyd(net, ordered.select("net", F.transform("a", lambda x: x["c"]).alias("centers")), rounds, "w")
    told = labelled(net.withColumnRenamed("set_id", "__old"), centers).drop("similarities", "similarity").join(ordered.select("net", F.transform("a", lambda x: x["set_id"]).alias("__ids")), "net")
    return told.withColumn("new_set_id", F.get("__ids", F.col("set_id"))).drop("set_id", "__ids").withColumnsRenamed({"__old": "set_id", "net": by})
