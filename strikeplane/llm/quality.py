"""Quality rules with risk-controlled thresholds.

Four rules each reject a document whose measure is above a cutoff. The cutoffs come from labelled documents:
for a stratum, a rule and each cutoff of a fixed ladder, the good documents of the holdout that it would reject
are counted. The exact binomial test asks whether so few could come about if more than a share `alpha` of all
good documents were rejected: P(Bin(n, alpha) <= k), the Clopper-Pearson bound turned round. Cutoffs are tested
from the most lenient on, and a rule's ladder ends at the first that fails, so its cutoffs need no correction
among themselves; `delta` is divided by strata times rules, and alpha by rules. So with probability 1 - delta,
in no stratum does the whole of the rules reject more than alpha of the good documents. Of the cutoffs that
pass, each stratum takes the one that rejects the most bad documents against good ones, the most lenient if
several do; a rule without one rejects nothing there.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: The measures and their ladders, the most lenient cutoff first.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_share": (0.2, 0.18, 0.16, 0.14, 0.12, 0.1),
    "capital_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4),
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_ascii_letters long"
#: A doc weighs as much as this many good ones when a cutoff is chosen among those that pass.
GOOD_WEIGHT = 20.0


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words which the text has at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    if len(seen) == len(words):
        return 0
    key = ids[:n].copy()
    width = len(seen)
    for i in range(1, window):
        if width * len(seen) >= 1 << 62:  # ranks instead, so that keys stay exact
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            width = int(key.max()) + 1
        key = key * len(seen) + ids[i : i + n]
        width *= len(seen)
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The numbers of MEASURES for one text; a null one is empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    data = np.frombuffer(raw, dtype=np.uint8)
    capitals = int(((data >= 65) & (data <= 90)).sum())
    small = int(((data >= 97) & (data <= 122)).sum())
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
        capitals,
        capitals + small,
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, columns of keep, those of MEASURES) of every document's whole text."""
    columns = (id_col, *keep)
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            got = np.array([measure(t.as_py()) for t in b.column(len(columns))], dtype=np.int64).reshape(-1, len(names))
            yield pa.record_batch([*b.columns[:-1], *(pa.array(got[:, i]) for i in range(len(names)))], names=[*(f"k{i}" for i in range(len(columns))), *names])

    types = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    out = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(columns)), F.col(text_col).alias("__text")).mapInArrow(batches, f"{types}, {MEASURES}")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(columns)), *names)


def judged(measured: DataFrame) -> DataFrame:
    """measured with base_failed, and with the share that each rule looks at."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return (
        measured.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("symbol_share", share("n_symbols", "word_chars"))
        .withColumn("dup_line_share", share("n_dup_lines", "n_lines"))
        .withColumn("repeat_share", share("n_repeat_words", "n_words"))
        .withColumn("capital_share", share("n_capitals", "n_ascii_letters"))
    )


def at_most(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly but for rounding."""
    if k >= n:
        return 1.0
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


def cutoffs(holdout: DataFrame, alpha: float = 0.05, delta: float = 0.05, stratum_col: str = "stratum", good_col: str = "good") -> DataFrame:
    """(stratum, one double for each rule, null where it rejects nothing) from labelled, judged documents.

    What is collected and tested are sums, one row for each stratum and cutoff.
    """
    ladder = [(rule, i, c) for rule, steps in RULES.items() for i, c in enumerate(steps)]
    sums = holdout.groupBy(F.col(stratum_col).alias("stratum")).agg(
        F.count(F.when(F.col(good_col), 1)).alias("n_good"),
        F.count(F.when(~F.col(good_col), 1)).alias("n_bad"),
        *(F.count(F.when(F.col(good_col) & (F.col(rule) > c), 1)).alias(f"good_{rule}_{i}") for rule, i, c in ladder),
        *(F.count(F.when(~F.col(good_col) & (F.col(rule) > c), 1)).alias(f"bad_{rule}_{i}") for rule, i, c in ladder),
    )
    strata = sums.count()

    def choose(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, share = delta / (max(1, strata) * len(RULES)), alpha / len(RULES)
        for pdf in found:
            rows = []
            for r in pdf.to_dict("records"):
                row: dict = {"stratum": r["stratum"]}
                for rule, steps in RULES.items():
                    best, row[rule] = 0.0, None
                    for i, c in enumerate(steps):
                        if not r["n_good"] or at_most(int(r[f"good_{rule}_{i}"]), int(r["n_good"]), share) > level:
                            break
                        gain = r[f"bad_{rule}_{i}"] / max(1, r["n_bad"]) - GOOD_WEIGHT * r[f"good_{rule}_{i}"] / r["n_good"]
                        if gain > best:
                            best, row[rule] = gain, c
                rows.append(row)
            yield pd.DataFrame(rows, columns=["stratum", *RULES]).astype({k: "float64" for k in RULES})

    kind = holdout.schema[stratum_col].dataType.simpleString()
    return sums.mapInPandas(choose, f"stratum {kind}, " + ", ".join(f"{r} double" for r in RULES))


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, the counts of MEASURES, base_failed, kept, n_rules_failed) of every document.

    labels has id_col and quality (1: good, 0: bad; other values and nulls teach nothing; a document labelled
    more than once counts by its lowest label). All labelled documents that pass the base rule are the holdout.
    Nulls in stratum_col are a stratum of their own. Without labels the base rule alone decides. A null text is
    empty and so fails the base rule. Repeated rows get equal rows; an empty table gives an empty one.
    """
    every = materialize(measures(docs, id_col, text_col, (stratum_col,)), "quality-measures").withColumnRenamed(stratum_col, "stratum")
    told = judged(every)
    said = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("quality"))
    holdout = told.filter(~F.col("base_failed")).join(said, F.col(id_col) == F.col("__id"), "inner").withColumn("good", F.col("quality") == 1)
    chosen = materialize(cutoffs(holdout, alpha, delta), "quality-cutoffs")  # a row for each stratum; Spark sees how small
    chosen = chosen.select(F.col("stratum").alias("__stratum"), *(F.col(r).alias(f"__{r}") for r in RULES))
    failed = sum((F.coalesce(F.col(r) > F.col(f"__{r}"), F.lit(False)).cast("int") for r in RULES), F.lit(0))
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return (
        told.join(chosen, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
        .withColumn("n_rules_failed", failed)
        .select(id_col, *names, "base_failed", (~F.col("base_failed") & (F.col("n_rules_failed") == 0)).alias("kept"), "n_rules_failed")
    )
