"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams tells the
languages whose codeword has a 1 there from the rest: its weights are log odds of the two sides' n-gram shares,
in which each language weighs the same, and its margin is their mean over a text. Decoding adds up, for each
language, the logistic loss of every bit's margin against the codeword, weighted by how far the bit's
classifier keeps the languages' own n-gram shares on their right sides, and takes the language of least loss. A small lead over the
second language marks the choice as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The value for a text that is null or has no letter.
UNDETERMINED = "und"
#: Bytes that are looked at in one go; a very long text takes no more memory than this many times a few.
_STEP = 1 << 20
_LETTER = regex.compile(r"\p{L}")
#: Letters of A-Z become small; bytes that are no letters and not part of one become a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _codes(data: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Hashed n-grams of bytes, for one n."""
    h = np.full(len(data) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for i in range(n):
        h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return h & np.uint32(buckets - 1)


def counts(text: str, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """How often each hashed n-gram of a text's bytes occurs, over the whole text. buckets is a power of two."""
    raw = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    data = np.frombuffer(b" " + b" ".join(raw.split()) + b" ", dtype=np.uint8)
    total = np.zeros(buckets, dtype=np.int64)
    for n in orders:
        for at in range(0, max(0, len(data) - n + 1), _STEP):
            total += np.bincount(_codes(data[at : at + _STEP + n - 1], n, buckets), minlength=buckets)
    return total


def codewords(languages: int) -> np.ndarray:
    """Rows of 0 and 1, one for each language, far apart from each other.

    Up to seven languages get the exhaustive code: every way to split them, once. More get the best of a
    hundred random codes of ten bits for each doubling, by least distance between two rows.
    """
    if languages <= 1:
        return np.ones((languages, 1), dtype=np.int8)
    if languages <= 7:
        return np.array([(1, *rest) for rest in product((0, 1), repeat=languages - 1) if not all(rest)], dtype=np.int8).T
    rng, bits, best, far = np.random.default_rng(11), int(np.ceil(10 * np.log2(languages))), None, -1
    for _ in range(100):
        code = rng.integers(0, 2, (languages, bits), dtype=np.int8)
        code = code[:, (code.min(axis=0) == 0) & (code.max(axis=0) == 1)]
        signs = 2 * code.astype(np.int32) - 1
        apart = (signs.shape[1] - signs @ signs.T) // 2
        np.fill_diagonal(apart, signs.shape[1])
        if apart.min() > far:
            best, far = code, int(apart.min())
    return best


@dataclass
class Model:
    """What a fit has learned. weights: a row for each n-gram bucket, a column for each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray
    orders: tuple[int, ...]
    buckets: int
    sharpness: float
    least_lead: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the choice is ambiguous."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        seen = counts(text, self.orders, self.buckets)
        margin = self.sharpness * (seen @ self.weights) / max(1, seen.sum())
        loss = (np.logaddexp(0, -margin * (2.0 * self.code - 1)) * self.bit_weight).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        odds = np.exp(loss[order[0]] - loss)
        score = float(1 / odds.sum())
        lead = float(loss[order[1]] - loss[order[0]]) if len(order) > 1 else np.inf
        return self.languages[order[0]], score, lead < self.least_lead


def crc_part(id_col: Column, parts: int = 4) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 14, sharpness: float = 3.0, least_lead: float = 0.5) -> Model:
    """Learn from a bounded sample of whole labelled texts: about per_language different texts of each language.

    Texts are chosen by a hash of their own, each once however many rows repeat it, so a rerun learns the same, and
    neither repeated nor null ids nor copies change how many there are. Rows with a null language or text teach
    nothing; languages are taken in code-point order. The driver gets one array of counts for each language, and no
    text; there should be as few languages as there are labels.
    """
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col), F.lit("language sample")).alias("h"))
    rows = {r["lang"]: r["n"] for r in known.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(rows, key=lambda x: x.encode("utf-8", "surrogatepass"))
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((buckets, code.shape[1])), np.ones(code.shape[1]), orders, buckets, sharpness, least_lead)
    share = F.create_map(*(F.lit(x) for k, n in rows.items() for x in (k, min(1.0, per_language / n))))
    # 53 bits of the hash: shares of any corpus can be told apart
    drawn = F.shiftrightunsigned("h", 11) < F.element_at(share, F.col("lang")) * (1 << 53)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in found:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                seen = counts(text.as_py(), orders, buckets).astype(np.float64)
                total[lang] = total.get(lang, 0) + seen / np.sqrt(max(1.0, seen.sum()))  # long texts don't drown short ones
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["lang", "seen"])

    parts = known.filter(drawn).dropDuplicates(["lang", "h"]).select("lang", "text").mapInArrow(batches, "lang string, seen array<double>")
    summed = parts.select("lang", F.posexplode("seen").alias("bucket", "n")).filter("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    dense = summed.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("seen"))
    got = {r["lang"]: r["seen"] for r in dense.collect()}  # at most `buckets` numbers for each language
    share_of = np.zeros((len(languages), buckets))
    for i, lang in enumerate(languages):
        for bucket, n in got.get(lang, {}).items():
            share_of[i, bucket] = n
    share_of = np.round(share_of, 6) + 0.5 / buckets  # rounded, as sums come in any order
    share_of /= share_of.sum(axis=1, keepdims=True)
    one = code.astype(np.float64)
    positive = (one.T @ share_of) / np.maximum(1, one.sum(axis=0))[:, None]
    negative = ((1 - one).T @ share_of) / np.maximum(1, (1 - one).sum(axis=0))[:, None]
    weights = np.log(positive) - np.log(negative) if len(languages) > 1 else np.zeros((1, buckets))
    # a bit counts by how far its margins on the languages' own shares lie on the right side
    margins = share_of @ weights.T * (2 * one - 1)
    bit_weight = np.maximum(margins.min(axis=0), 1e-3)
    return Model(languages, code, weights.T.copy(), bit_weight / bit_weight.mean(), orders, buckets, sharpness, least_lead)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, with lang_pred string, score double (0 to 1) and ambiguous boolean.

    Only the text decides, and all of it. A null text or one without a letter is `und`, score 0, ambiguous, and
    so is every text if nothing was learned. Repeated rows get equal rows; an empty table gives an empty one.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # buckets x bits numbers, whatever the input

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            said = [known.value.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.record_batch(
                [*b.columns[:-1], pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()), pa.array([x[2] for x in said], pa.bool_())],
                names=[*(f"k{i}" for i in range(len(keep))), "lang_pred", "score", "ambiguous"],
            )

    types = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("__text")).mapInArrow(batches, f"{types}, lang_pred string, score double, ambiguous boolean")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "ambiguous")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents, their columns as they are whatever their names, whose language is neither undetermined nor ambiguous.

    The model learns from the documents' own labels, but for the held-out quarter.
    """
    model = fit(docs.filter(crc_part(F.col("doc_id")) != 2))
    columns = tuple(docs.columns)
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    said = predict(named, model, f"c{columns.index('text')}", tuple(named.columns))
    return said.filter((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
