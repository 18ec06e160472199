"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus, computed by joins.

The relation of n-grams is held in packed rows: one row has the distinct n-grams of a block of documents that
fall into one hash partition, as sorted 64-bit hashes. Such a row is an exploded set of n-grams that shuffles
in a fraction of the bytes. Rows of one hash partition meet, which makes that partition's count table and joins
it to the rows in one step; the counts go back to their blocks, whose documents sum up their scores.

A document is scored by the other documents' counts: its own are taken off first. With words w_1 ... w_m and
counts c, a word after its context scores c(context, word) / c(context), or backoff times the score after a
shorter context if c(context, word) is 0; a word alone scores (c(word) + 1) / (N + V + 1), with N the other
documents' words and V the corpus's distinct ones, so that a word which nobody else has scores above 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, n_words

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _stir(h: np.ndarray) -> np.ndarray:
    """A steady, reversible mixing of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _squeeze(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, like bytes of them side by side, compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _stretch(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


class Block:
    """Words of some documents, as numbers of the block's own vocabulary."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, ends: np.ndarray, order: int):
        self.hashes, self.words, self.ends, self.order = hashes, words, ends, order

    @classmethod
    def of(cls, texts: list[str], order: int) -> Block:
        seen: dict[bytes, int] = {}
        number = seen.setdefault
        words, ends, at = [], [], 0
        for text in texts:
            found = text.encode("utf-8", "surrogatepass").lower().split()
            words.append(np.fromiter((number(w, len(seen)) for w in found), dtype=np.uint32, count=len(found)))
            at += len(found)
            ends.append(at)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in seen), dtype=np.uint64, count=len(seen))
        return cls(hashes, np.concatenate(words) if words else np.empty(0, np.uint32), np.array(ends, dtype=np.int64), order)

    def grams(self) -> list[np.ndarray]:
        """For each length from 1 on, the hash of the n-gram that ends at each word; 0 where none does."""
        place = np.arange(len(self.words)) - np.repeat(np.concatenate([[0], self.ends[:-1]]), np.diff(self.ends, prepend=0))
        one = self.hashes[self.words]
        out, h = [], np.zeros(len(one), dtype=np.uint64)
        for n in range(1, self.order + 1):
            # the hash of words i-n+1 .. i, built from its first word on
            h = np.zeros(len(one), dtype=np.uint64)
            for back in range(n - 1, -1, -1):
                h[n - 1 :] = _stir(h[n - 1 :] * _MIX + one[n - 1 - back : len(one) - back] + np.uint64(n))
            h[h == 0] = 1
            h[place < n - 1] = 0
            out.append(h)
        return out

    def owners(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a block, sorted, with how often each occurs."""
    every = np.concatenate(grams)
    return np.unique(every[every != 0], return_counts=True)


def score(docs: DataFrame, order: int = 2, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text", block_chars: int | None = None, partition_words: int | None = None) -> DataFrame:
    """(id_col, n_words long, log_score double) of every document: the sum of its words' log scores.

    Words are lower-cased (A-Z). A null or empty text has no word and scores 0. Rows are documents, also where
    ids repeat or are null. An empty table gives an empty one. A block holds about block_chars characters, or
    one document if that is longer; a hash partition about partition_words words. They default to 4 and 1
    million, and grow with the square root of the words from 2**28 on, to four times as much: so far the packed
    rows grow as the input does. Beyond, a block leaves out the partitions that it has no n-gram for, so there
    are never more rows than n-grams.
    """
    words = docs.agg(F.sum(n_words(F.col(text_col)))).first()[0] or 0
    growth = min(4.0, max(1.0, (words / (1 << 28)) ** 0.5))
    block_chars, partition_words = block_chars or int(4_000_000 * growth), partition_words or int(1_000_000 * growth)
    parts = max(1, -(-words // partition_words))
    cuts = np.array([(i << 64) // parts for i in range(1, parts)], dtype=object)
    edges = np.array([int(c) for c in cuts], dtype=np.uint64)
    kind = docs.schema[id_col].dataType.simpleString()

    def blocks(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task = 0, TaskContext.get().partitionId()

        def pack(ids: list, texts: list[str]) -> pa.RecordBatch:
            b = Block.of(texts, order)
            row = {"block": (task << 32) + made, "ids": ids, "hashes": _squeeze(b.hashes), "words": _squeeze(b.words), "ends": b.ends.tolist()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        ids, texts, chars, schema = [], [], 0, None
        for batch in found:
            schema = schema or pa.schema([("block", pa.int64()), ("ids", pa.list_(batch.schema.field(0).type)), ("hashes", pa.binary()), ("words", pa.binary()), ("ends", pa.list_(pa.int64()))])
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(t.as_py() or "")
                chars += len(texts[-1])
                if chars >= block_chars:
                    yield pack(ids, texts)
                    made, ids, texts, chars = made + 1, [], [], 0
        if ids:
            yield pack(ids, texts)

    packed = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(blocks, f"block long, ids array<{kind}>, hashes binary, words binary, ends array<bigint>"),
        "lm-blocks",
    )

    def explode(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for r in batch.to_pylist():
                b = Block(_stretch(r["hashes"], "<u8"), _stretch(r["words"], "<u4"), np.array(r["ends"], dtype=np.int64), order)
                keys, n = _distinct(b.grams())
                at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)
                vocabulary = np.unique(_vocabulary(b))
                in_v = np.isin(keys, vocabulary)
                for p in np.flatnonzero(np.diff(at)).tolist():
                    k = keys[at[p] : at[p + 1]]
                    flags = np.packbits(in_v[at[p] : at[p + 1]])
                    gaps = np.diff(k, prepend=np.uint64(0))
                    yield pa.record_batch(
                        [pa.array([p], pa.int32()), pa.array([r["block"]], pa.int64()), pa.array([_squeeze(gaps)], pa.binary()), pa.array([_squeeze(n[at[p] : at[p + 1]].astype("<u4"))], pa.binary()), pa.array([flags.tobytes()], pa.binary())],
                        names=["part", "block", "keys", "n", "single"],
                    )

    def count(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(_stretch(x.as_py(), "<u8"), dtype=np.uint64) for x in group.column("keys")]
        n = [_stretch(x.as_py(), "<u4") for x in group.column("n")]
        single = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[: len(k)] for x, k in zip(group.column("single"), keys)]
        table, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(n).astype(np.float64), minlength=len(table)).astype(np.int64)
        is_word = np.zeros(len(table), dtype=bool)
        is_word[where[np.concatenate(single) > 0]] = True
        ends = np.cumsum([len(k) for k in keys])[:-1]
        back = [_squeeze(total[w].astype("<u4" if total.max() < 2**32 else "<u8")) for w in np.split(where, ends)]
        wide = total.max() >= 2**32
        words_here = int(is_word.sum())
        tokens = int(total[is_word].sum())
        return pa.table({"block": group.column("block"), "part": group.column("part"), "counts": pa.array(back, pa.binary()), "wide": pa.array([bool(wide)] * len(back)), "words": pa.array([words_here] * len(back), pa.int64()), "tokens": pa.array([tokens] * len(back), pa.int64())})

    asked = packed.select("block", "hashes", "words", "ends").mapInArrow(explode, "part int, block long, keys binary, n binary, single binary")
    answered = materialize(asked.groupBy("part").applyInArrow(count, "block long, part int, counts binary, wide boolean, words long, tokens long"), "lm-counts")
    sizes = answered.groupBy("part").agg(F.first("words").alias("words"), F.first("tokens").alias("tokens")).agg(F.sum("words"), F.sum("tokens")).first()
    vocabulary_size, tokens = int(sizes[0] or 0), int(sizes[1] or 0)

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        b = Block(_stretch(r["hashes"], "<u8"), _stretch(r["words"], "<u4"), np.array(r["ends"], dtype=np.int64), order)
        grams = b.grams()
        keys, _ = _distinct(grams)
        got = sorted(right.to_pylist(), key=lambda x: x["part"])
        total = np.concatenate([_stretch(x["counts"], "<u8" if x["wide"] else "<u4").astype(np.int64) for x in got]) if got else np.empty(0, np.int64)
        owner = b.owners()
        length = np.diff(b.ends, prepend=0)
        others: list[np.ndarray] = []
        for g in grams:
            c = np.zeros(len(g), dtype=np.int64)
            real = np.flatnonzero(g != 0)
            if len(real):
                at = np.searchsorted(keys, g[real])
                # the document's own count of each n-gram
                _, inverse, own = np.unique(owner[real] * np.int64(len(keys)) + at, return_inverse=True, return_counts=True)
                c[real] = total[at] - own[inverse]
            others.append(c)
        log_p = np.log(others[0] + 1.0) - np.log(tokens - length[owner] + vocabulary_size + 1.0)
        for n in range(2, order + 1):
            context = np.concatenate([[0], others[n - 2][:-1]]) if len(log_p) else others[n - 2]
            seen = others[n - 1] > 0
            shorter = np.log(backoff) + log_p
            here = grams[n - 1] != 0
            longer = np.log(np.maximum(others[n - 1], 1)) - np.log(np.maximum(context, 1))
            log_p = np.where(here, np.where(seen, longer, shorter), log_p)
        sums = np.bincount(owner, weights=log_p, minlength=len(length)) if len(owner) else np.zeros(len(length))
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table({"id": ids, "n_words": pa.array(length, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    scored = packed.groupBy("block").cogroup(answered.select("block", "part", "counts", "wide").groupBy("block")).applyInArrow(sum_up, f"id {kind}, n_words long, log_score double")
    return scored.withColumnRenamed("id", id_col)


def _vocabulary(b: Block) -> np.ndarray:
    """The hashes that grams() gives a block's single words."""
    h = _stir(b.hashes + np.uint64(1))
    h[h == 0] = 1
    return h
