"""Mixing sources to target weights: whole copies first, then Pareto order sampling, by DataFrame functions alone.

A source has a target in words. Document i of it, of merit m_i, is wanted e_i = min(max_copies, c * m_i) times; c
is such that the source's words, each wanted so often, are the target. It takes floor(e_i) whole copies for certain.
For the rest it has the inclusion probability p_i = e_i - floor(e_i), a uniform number u_i that follows from its
name and the seed, and the rank value q_i = (u_i / (1 - u_i)) / (p_i / (1 - p_i)), random odds divided by inclusion
odds. The sample is the documents of smallest q, of a fixed size that is stated in words: as many as come nearest
to the words that are left. A document is in it with a chance close to p_i, as q_i <= 1 has just that chance.

The rank's cut is found without sorting a source in one task: sums of words by ranges of q show the range in
which the cut lies, which is split twice more; only what is in the last range is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, join_unhot, materialize, n_words, with_row_key

#: A merit is a whole number from 1 to this one, so a source has no more classes of documents.
MOST_MERIT = 1000
#: Rows alike in source, id and size that are numbered in one go.
CHUNK = 1000
#: Ranges into which the rank values are split, at each of LEVELS steps.
RANGES = 256
LEVELS = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: float = 3.0, source_col: str = "source") -> DataFrame:
    """(source_col, source_size long, target double) for a table with source_col and a long `size`.

    Sources in code-point order, null last, weigh what weights says, from its start again when it ends. Targets
    share all sizes by weight; one stops at max_copies times its source's size and the excess goes to the others
    by weight until none is above. That is: targets are min(cap, level * weight), and the level is found from
    the sources in order of cap / weight.
    """
    listed = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    capped = listed.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col(source_col).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        capped.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(order), F.lit(0.0))))
    )
    # the first source, in this order, whose cap is not below its share sets the level of all after it
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("k"), F.col("level")))
    level = F.min(fits).over(everything)["level"]
    return levels.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("w")), F.col("cap"))).select(source_col, "source_size", "target")


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that follows from key, a string, and the seed: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def merit_of_size(size: Column) -> Column:
    """The merit that mix() and take() give: the binary digits of a document's words, so longer ones are wanted more."""
    return F.length(F.bin(size))


def wanted(rows: DataFrame, targets: DataFrame, max_copies: float) -> DataFrame:
    """(src, merit, e double, left double): the copies wanted of each source's documents of a merit, and the source's words left after whole ones.

    A class of documents stops at max_copies times its words, as a source does in source_targets(); the level c
    is found from the classes in order of merit, the largest first. Windows hold a source's classes, which are
    at most MOST_MERIT.
    """
    classes = rows.filter("size > 0").groupBy(F.col("source").alias("src"), "merit").agg(F.sum("size").alias("words"))
    known = classes.join(targets, F.col("src").eqNullSafe(F.col("source")), "inner").select("src", "merit", "words", "target")
    everything = Window.partitionBy("src")
    before = everything.orderBy(F.desc("merit")).rowsBetween(Window.unboundedPreceding, -1)
    weight, most = F.col("words") * F.col("merit"), F.lit(float(max_copies))
    levels = known.withColumn(
        "level",
        (F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))) / (F.sum(weight).over(everything) - F.coalesce(F.sum(weight).over(before), F.lit(0))),
    )
    # the largest merit whose copies are not above the most sets the level of all below it
    c = F.max(F.when(F.col("level") * F.col("merit") <= most, F.struct("merit", "level"))).over(everything)["level"]
    made = levels.withColumn("e", F.coalesce(F.least(most, c * F.col("merit")), most))
    return made.withColumn("left", F.col("target") - F.sum(F.floor("e") * F.col("words")).over(everything)).select("src", "merit", "e", "left")


def copies(rows: DataFrame, targets: DataFrame, max_copies: float = 3.0, seed: int = 7) -> DataFrame:
    """rows (name string, source, size long, merit int, others) with source_size, target and `copies` int, the times a row is taken.

    A row without words is not taken. Rows of one name draw the same number; where that must not be, names differ.
    """
    rows = rows.withColumn("merit", F.greatest(F.lit(1), F.least(F.lit(MOST_MERIT), F.coalesce("merit", F.lit(1)))))
    # rows for each source and merit, in a file whose size Spark knows before it joins
    classes = materialize(wanted(rows, targets, max_copies).withColumnRenamed("merit", "m"), "mix-wanted")
    u = F.col("__u")
    drawn = (
        rows.join(targets.withColumnRenamed("source", "t_src"), F.col("source").eqNullSafe(F.col("t_src")), "inner")
        .join(classes, F.col("source").eqNullSafe(F.col("src")) & (F.col("merit") == F.col("m")) & (F.col("size") > 0), "left")
        .withColumn("__whole", F.coalesce(F.floor("e"), F.lit(0)).cast("int"))
        .withColumn("__p", F.col("e") - F.col("__whole"))
        .withColumn("__u", uniform(F.col("name"), seed))
        .withColumn("__q", F.when(F.col("__p") > 0, (u / (1 - u)) / (F.col("__p") / (1 - F.col("__p")))))
        # a steady image of the rank value between 0 and 1
        .withColumn("__z", F.col("__q") / (1 + F.col("__q")))
        .withColumn("__b", F.least(F.floor(F.col("__z") * F.lit(float(RANGES**LEVELS))), F.lit(RANGES**LEVELS - 1)).cast("long"))
    )
    cut = drawn.select("src", "size", "__q", "__b", "name", "left").filter("__b is not null")
    inside = materialize(cut.groupBy("src", "__b").agg(F.sum("size").alias("n"), F.first("left").alias("left")), "mix-ranges")
    found = None
    for level in range(LEVELS):
        unit = RANGES ** (LEVELS - 1 - level)
        level_rows = inside if found is None else inside.join(found, inside["src"].eqNullSafe(found["f_src"]) & (F.floor(F.col("__b") / (unit * RANGES)) == F.col("f_range")), "inner").withColumn("left", F.col("f_left"))
        sums = level_rows.groupBy("src", F.floor(F.col("__b") / unit).alias("range")).agg(F.sum("n").alias("n"), F.first("left").alias("left"))
        w = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        # the last range that begins below the words left
        hit = before.filter(F.col("before") < F.col("left")).groupBy("src").agg(F.max(F.struct("range", (F.col("left") - F.col("before")).alias("left"))).alias("hit"))
        # a row for each source
        found = materialize(hit.select(F.col("src").alias("f_src"), F.col("hit.range").alias("f_range"), F.col("hit.left").alias("f_left")), "mix-cut")
    last = cut.drop("left").join(found, cut["src"].eqNullSafe(found["f_src"]) & (cut["__b"] == found["f_range"]), "inner")
    w = Window.partitionBy("src").orderBy("__q", "name", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = last.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    # a document is in if taking it brings the words nearer to what is left than leaving it out
    taken = ordered.filter(F.col("before") + F.col("size") / 2 <= F.col("f_left"))
    edge = taken.groupBy("src").agg(F.max(F.struct("__q", "name", "size")).alias("edge"))
    cuts = materialize(
        found.join(edge, found["f_src"].eqNullSafe(edge["src"]), "left")
        .select(F.col("f_src").alias("__src"), F.col("f_range").alias("__range"), F.col("edge").alias("__edge")),
        "mix-cut",
    )
    is_in = (F.col("__b") < F.col("__range")) | ((F.col("__b") == F.col("__range")) & (F.struct("__q", "name", "size") <= F.col("__edge")))
    return (
        drawn.join(cuts, drawn["source"].eqNullSafe(cuts["__src"]), "left")
        .withColumn("copies", F.col("__whole") + F.when(F.coalesce(is_in, F.lit(False)), 1).otherwise(0))
        .drop("t_src", "src", "m", "e", "left", "__whole", "__p", "__u", "__q", "__z", "__b", "__src", "__range", "__edge")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: float = 3.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id_col, source_col, size, source_size, target, copies) of every row of docs.

    A document's size is its words (null: 0), its merit is merit_of_size(). Null sources are one source, the
    last. A document without words is not taken, nor is a source without any. Rows alike in source, id (or in
    having none) and size are numbered and drawn one by one; which of them is which number makes no difference
    to what is returned. An empty table gives an empty one.
    """
    alike = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")).groupBy("source", "id", "size").agg(F.count("*").alias("n"))
    chunks = alike.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    each = chunks.withColumn("k", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + CHUNK, F.col("n")) - 1)))
    name = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("size").cast("string"), F.col("k").cast("string"))
    rows = materialize(each.select("id", "source", "size", name.alias("name"), merit_of_size(F.col("size")).alias("merit")), "mix-sizes")
    targets = materialize(source_targets(rows, weights, max_copies), "mix-targets")
    return copies(rows, targets, max_copies, seed).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies")


def take(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: float = 3.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", merit_col: str | None = None) -> DataFrame:
    """The mix itself: docs, all columns, each row as often as it is taken.

    Merits are whole numbers of merit_col (null: 1), else merit_of_size(). Each row is a document of its own,
    named by a key that is written first: rows alike in id, or in having none, and in size are drawn apart.
    Columns of any name stay as they are.
    """
    keyed, key = with_row_key(docs, "mix-rows")
    merit = F.col(merit_col).cast("int") if merit_col else None
    size = n_words(F.col(text_col))
    name = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), size.cast("string"))
    sized = materialize(
        keyed.select(F.col(key).alias("row"), F.col(source_col).alias("source"), size.alias("size"), name.alias("k"), (merit if merit is not None else merit_of_size(size)).alias("merit")), "mix-sizes"
    )
    # a row that has its id and size to itself is drawn by them; others by their keys too
    groups = materialize(sized.groupBy("k").agg(F.min("row").alias("row"), F.min("source").alias("source"), F.min("size").alias("size"), F.min("merit").alias("merit"), F.count("*").alias("n")), "mix-names")
    single = groups.filter("n = 1").select("row", "source", "size", "merit", F.concat("k", F.lit(":0")).alias("name"))
    many = join_unhot(sized, groups.filter("n > 1").select("k", "n"), "k", "n").select("row", "source", "size", "merit", F.concat_ws("#", "k", F.col("row").cast("string")).alias("name"))
    named = materialize(single.unionByName(many), "mix-named")
    targets = materialize(source_targets(named, weights, max_copies), "mix-targets")
    n_col, row_col, copy_col = (free_name(keyed, x) for x in ("__copies", "__taken", "__copy"))
    times = copies(named, targets, max_copies, seed).filter("copies > 0").select(F.col("row").alias(row_col), F.col("copies").alias(n_col))
    # texts are streamed past the rows taken, and not sorted: the same plan at any size
    joined = keyed.join(times.hint("shuffle_hash"), keyed[key] == times[row_col], "inner")
    return joined.withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(n_col)))).select(docs.columns)
