"""Secret scans by DataFrame functions alone: fixed patterns, and sliding-window entropy of candidate strings.

Spark finds all matches of a pattern in a text but not their places. The text split by the same pattern gives
what lies between the matches, and the sums of both lengths give the places, in code points.

A candidate string belongs to a character class. A window slides over it; counts of the characters in the
window change by the one that enters and the one that leaves, and with them the sum of n * log2(n), from which
the window's Shannon entropy follows. A candidate whose best window reaches its class's threshold is a secret
unless an allow-list pattern fits it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name

#: Steps of a running sum that are made in one piece, so that long arrays take linear time.
_STEP = 256


@dataclass(frozen=True)
class Pattern:
    """Matches of regex whose group is at least `least` characters long."""

    kind: str
    regex: str
    group: int
    least: int
    #: A cheaper pattern that any text with a match has.
    hint: str


@dataclass(frozen=True)
class CharacterClass:
    """Candidate strings over an alphabet, and the entropy in bits that a window of one must reach."""

    kind: str
    regex: str
    alphabet: str
    window: int
    threshold: float
    #: Patterns that a candidate must all have.
    needs: tuple[str, ...] = ()


# The base patterns and the order of their kinds.
PATTERNS = (
    Pattern("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    # the same as runs of any length of which the short ones are dropped: a run has no longer one inside it
    Pattern("access", r"AKIA[A-Z0-9]{16,}", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Pattern("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
HEX_DIGITS = "0123456789abcdef"
BASE64_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CLASSES = (
    CharacterClass("entropy_hex", r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{24,}(?![A-Za-z0-9+/_=-])", HEX_DIGITS, 24, 2.95, (r"[0-9]", r"[A-Fa-f]")),
    CharacterClass("entropy_base64", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}", BASE64_DIGITS, 24, 3.85, (r"[0-9]", r"[A-Z]", r"[a-z]")),
)
#: What a candidate may be without being a secret: examples, UUIDs, runs of digits, hyphened words.
ALLOWED = (
    r"(?i)example|sample|placeholder|xxxx",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9]+$",
    r"^[A-Za-z]++(?:[_-][A-Za-z]++)++$",  # possessive: no step back, and no deeper stack for longer words
    r"^https?/",
)


def _before(values: Column, join, first: int) -> Column:
    """For each entry of an array of ints, what join makes of first and the entries before it."""

    def running(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.lit(first).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
            lambda s, n: F.struct(join(s["at"], n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")),
        )

    def before(parts: Column) -> Column:
        return F.aggregate(
            parts,
            F.struct(F.lit(first).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("all")),
            lambda s, p: F.struct(join(s["at"], p["at"]).alias("at"), F.concat(s["all"], F.array(F.transform(p["all"], lambda x: join(x, s["at"])))).alias("all")),
        )["all"]

    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _STEP).cast("int"))
    return F.flatten(before(F.transform(starts, lambda i: running(F.slice(values, i * _STEP + 1, F.lit(_STEP))))))


def _spans(text: Column, regex: str, keep) -> Column:
    """Array of struct(start, end) of the matches of regex that keep(match) holds for, found from the left without overlap."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    between = F.transform(F.split(text, regex), F.length)
    lengths = F.transform(found, F.length)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), lengths, lambda a, b: a + b)
    ends = F.zip_with(_before(steps, lambda a, b: a + b, 0), steps, lambda a, b: a + b)
    spans = F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("m")))
    return F.transform(F.filter(spans, lambda s: keep(s["m"])), lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))


def _entropy(candidate: Column, alphabet: str, window: int) -> Column:
    """The largest Shannon entropy, in bits a character, of the candidate's windows; counts change step by step.

    Counts lie side by side in a few longs, so a step that takes one character in and one out costs the same
    whatever the alphabet's size.
    """
    bits = (window + 1).bit_length()
    per = 62 // bits
    longs = -(-len(alphabet) // per)
    table = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)))
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    start = F.struct(F.array(*(F.lit(0).cast("long") for _ in range(longs))).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))
    # for each code: its long, its place there, and one at that place
    long_of = F.array(*(F.lit(c // per) for c in range(len(alphabet))))
    place_of = F.array(*(F.lit(bits * (c % per)) for c in range(len(alphabet))))
    unit_of = F.array(*(F.lit(1 << (bits * (c % per))).cast("long") for c in range(len(alphabet))))

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, F.get(long_of, code)), F.get(place_of, code)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def step(codes: Column):
        def go(s: Column, i: Column) -> Column:
            enters = F.element_at(codes, i + 1)
            leaves = F.when(i >= window, F.element_at(codes, F.greatest(i - window + 1, F.lit(1))))
            n_out = F.when(leaves.isNull(), 0).otherwise(count(s["counts"], leaves))
            n_in = count(s["counts"], enters) - F.when(leaves == enters, 1).otherwise(0)
            total = s["sum"] + F.get(table, n_in + 1) - F.get(table, n_in) + F.when(n_out > 0, F.get(table, n_out - 1) - F.get(table, n_out)).otherwise(0.0)
            here = lambda k: F.when(F.get(long_of, enters) == k, F.get(unit_of, enters)).otherwise(0) - F.when(F.get(long_of, leaves) == k, F.get(unit_of, leaves)).otherwise(0)
            counts = F.array(*(F.get(s["counts"], F.lit(k)) + here(k) for k in range(longs)))
            entropy = F.lit(math.log2(window)) - total / F.lit(float(window))
            best = F.when(i >= window - 1, F.greatest(s["best"], entropy)).otherwise(s["best"])
            return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

        return go

    one = F.transform(
        F.array(codes),
        lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), start, step(c), lambda s: s["best"]),
    )
    return F.get(one, F.lit(0))


def _clear_of_base(both: Column, n_base: int) -> Column:
    """Spans in order, of base kinds and others, without those of the others that a base span overlaps.

    Before a span in this order, bases begin no later: one overlaps if the furthest end of them is beyond the
    span's start. After it, they begin no earlier: one overlaps if the nearest start is before the span's end.
    """
    far = 2**31 - 1
    ends = F.transform(both, lambda s: F.when(s["rank"] < n_base, s["end"]).otherwise(0).cast("int"))
    starts = F.transform(F.reverse(both), lambda s: F.when(s["rank"] < n_base, s["start"]).otherwise(far).cast("int"))
    marked = F.zip_with(
        F.zip_with(both, _before(ends, F.greatest, 0), lambda s, e: F.struct(s.alias("s"), e.alias("e"))),
        F.reverse(_before(starts, F.least, far)),
        lambda x, n: F.struct(x["s"].alias("s"), x["e"].alias("e"), n.alias("n")),
    )
    clear = F.filter(marked, lambda x: (x["s"]["rank"] < n_base) | ((x["e"] <= x["s"]["start"]) & (x["n"] >= x["s"]["end"])))
    return F.transform(clear, lambda x: x["s"])


def spans(text: Column, patterns: tuple[Pattern, ...] = PATTERNS, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Array of struct(start long, rank int, kind, end long) of what is found in a text, in order; null: none.

    rank is the kind's place in patterns and then classes. Every match of a pattern that is long enough stays;
    an entropy span is left out where a pattern's span overlaps it or an allow-list pattern fits it.
    """
    text = F.coalesce(text, F.lit(""))
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)")

    def named(found: Column, rank: int, kind: str) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    base = []
    for rank, p in enumerate(patterns):
        def long_enough(m: Column, p: Pattern = p) -> Column:
            return F.length(F.regexp_extract(m, p.regex, p.group)) >= p.least if p.group else F.length(m) >= p.least

        base.append(F.when(text.rlike(p.hint), named(_spans(text, p.regex, long_enough), rank, p.kind)).otherwise(none))
    more = []
    for rank, c in enumerate(classes, len(patterns)):
        def risky(m: Column, c: CharacterClass = c) -> Column:
            holds = F.lit(True)
            for need in c.needs:
                holds &= m.rlike(need)
            for fine in allowed:
                holds &= ~m.rlike(fine)
            same = F.lower(m) if c.alphabet == c.alphabet.lower() else m
            return F.when(holds, _entropy(same, c.alphabet, c.window) >= c.threshold).otherwise(F.lit(False))

        more.append(F.when(text.rlike(c.regex), named(_spans(text, c.regex, risky), rank, c.kind)).otherwise(none))
    base_spans = F.concat(*base) if base else none
    more_spans = F.concat(*more) if more else none
    # made once, then looked at twice
    found = F.transform(
        F.array(F.struct(base_spans.alias("base"), more_spans.alias("more"))),
        lambda x: F.when((F.size(x["more"]) == 0) | (F.size(x["base"]) == 0), F.array_sort(F.concat(x["base"], x["more"]))).otherwise(
            F.get(F.transform(F.array(F.array_sort(F.concat(x["base"], x["more"]))), lambda both: _clear_of_base(both, len(patterns))), F.lit(0))
        ),
    )
    return F.get(found, F.lit(0))


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans", **how) -> DataFrame:
    """docs, all columns, with the spans of spans() in out_col (an input column of this name is replaced).

    A null or empty text has none. Rows are judged alone: repeated rows get equal spans, an empty table none.
    """
    return docs.withColumn(out_col, spans(F.col(text_col), **how))


#: Code points of a chunk, from which a piece of a text is taken without counting from the text's start.
CHUNK = 1024


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x made once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _covered(found: Column) -> Column:
    """Array of struct(start, end): the places that spans cover; spans that overlap are one place, in linear time.

    Among sorted starts and sorted ends, a place begins at the i-th start if the i ends before it are all behind.
    """

    def places(x: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(x["s"]) - 1), lambda i: (i == 0) | (F.get(x["e"], i - 1) <= F.get(x["s"], i)))
        whole = lambda at: F.transform(at, lambda i, k: F.struct(F.get(x["s"], i).alias("start"), F.get(x["e"], F.coalesce(F.get(at, k + 1), F.size(x["s"])) - 1).alias("end")))
        return _bound(begins, whole)

    return _bound(F.struct(F.array_sort(F.transform(found, lambda s: s["start"])).alias("s"), F.array_sort(F.transform(found, lambda s: s["end"])).alias("e")), places)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **how) -> DataFrame:
    """docs with each secret replaced by mark; spans that overlap are replaced as one. A null text stays null.

    All columns keep their names and values, whatever they are called. The time goes with the length of the text,
    however many secrets it holds: pieces between them are taken from chunks of CHUNK code points.
    """
    found = free_name(docs, "__secret_spans")
    scanned = scan(docs, text_col, found, **how)
    text = F.col(text_col)

    def cut(x: Column) -> Column:
        def piece(begin: Column, end: Column) -> Column:
            first = F.floor(begin / CHUNK).cast("int")
            around = F.array_join(F.slice(x["chunks"], first + 1, F.floor(end / CHUNK).cast("int") - first + 1), "")
            return F.substring(around, (begin - first * CHUNK + 1).cast("int"), (end - begin).cast("int"))

        end = lambda k: F.coalesce(F.get(x["places"], k)["end"], F.lit(0).cast("long"))
        before = F.transform(x["places"], lambda p, k: piece(end(k - 1), p["start"]))
        return F.array_join(F.concat(before, F.array(piece(end(F.size(x["places"]) - 1), x["length"]))), mark)

    parts = F.struct(_covered(F.col(found)).alias("places"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"), F.length(text).cast("long").alias("length"))
    return scanned.withColumn(text_col, F.when(F.size(found) > 0, _bound(parts, cut)).otherwise(text)).select(docs.columns)
