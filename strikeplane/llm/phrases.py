"""Collocations by prefix-free parsing: chunks that the words themselves cut, a dictionary of them, counts inside it.

A text's pieces are cut before every trigger word, a word whose hash is divisible by `every`. What lies between two
cuts is a chunk; it is followed by the next LONGEST - 1 words, so every n-gram lies whole in the chunk in which it
starts, and belongs to that chunk alone. Equal passages are cut alike, so copies give equal chunks: the dictionary
has each once, with its frequency in the parse, and all counting reads the dictionary.

A phrase can occur `least` times only if all that lies in it does. So words are counted first, then pairs of words
that are frequent, by 64-bit hashes; what is frequent goes out as a bitmap whose size is bounded. The last pass counts
phrases of all lengths whose pairs may be frequent by their strings. Hashes and bitmaps only rule out phrases that are
too rare, so counts are exact whatever collides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bitmap, in_bitmap, materialize

#: Words of the longest phrase.
LONGEST = 4
_PIECES = re.compile(rb"[.,;:!?\x0A-\x0D]+")


class Triggers(dict):
    """Whether a word starts a chunk: one in `every` does, by its hash. Answers are kept for the words seen last."""

    def __init__(self, every: int, most: int = 1 << 20):
        super().__init__()
        self.every, self.most = every, most

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= self.most:
            self.clear()
        cut = self[word] = xxhash.xxh32_intdigest(word) % self.every == 0
        return cut


def chunks(text: str | None, triggers: Triggers) -> Iterator[bytes]:
    """The chunks of one text: own words and, behind a tab, those that only complete n-grams."""
    for piece in _PIECES.split((text or "").encode("utf-8", "surrogatepass").lower()):
        words = piece.split()
        cuts = [i for i in range(1, len(words)) if triggers[words[i]]]
        if not cuts:
            if words:
                yield b" ".join(words)
            continue
        for begin, end in zip([0, *cuts], [*cuts, len(words)]):
            after = words[end : end + LONGEST - 1]
            yield b" ".join(words[begin:end]) + (b"\t" + b" ".join(after) if after else b"")


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", every: int = 8) -> DataFrame:
    """(lang, chunk, n): each distinct chunk of each language with its frequency in the parse; a null language is `und`."""

    def parsed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triggers = Triggers(every)
        for b in found:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                seen.setdefault(lang, Counter()).update(chunks(text.as_py(), triggers))
            for lang, n in seen.items():
                yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["lang", "chunk", "n"])

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(parsed, "lang string, chunk binary, n long").select("lang", F.col("chunk").cast("string").alias("chunk"), "n")
    return found.groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


#: Odd numbers: the base of the polynomial that hashes a word's bytes, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones((2, 1), dtype=np.uint64)


def _powers(size: int) -> np.ndarray:
    """Powers of the base and of its inverse up to a size; kept for the next block."""
    global _POWERS
    if _POWERS.shape[1] < size:
        grown = np.array([[_BASE], [_INVERSE]], dtype=np.uint64) * np.ones((1, size), dtype=np.uint64)
        grown[:, 0] = 1
        _POWERS = np.multiply.accumulate(grown, axis=1)
    return _POWERS[:, :size]


class Block:
    """Chunks as flat arrays: where words lie, their hashes, and which n-grams each chunk owns."""

    def __init__(self, table: pa.Table):
        langs = table.column(0).combine_chunks().dictionary_encode()
        self.langs, self.lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        texts = table.column(1).combine_chunks()
        self.line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_py().encode("utf-8", "surrogatepass") + b"\n"
        raw = np.frombuffer(self.line, dtype=np.uint8)
        self.ends = np.flatnonzero((raw == 32) | (raw == 9) | (raw == 10))
        mark = raw[self.ends]
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64)
        new = np.concatenate([[True], mark[:-1] == 10])
        self.chunk = np.cumsum(new) - 1
        tabs = np.cumsum(mark == 9) - (mark == 9)  # tabs before a word's end
        self.own = tabs == tabs[np.flatnonzero(new)][self.chunk]
        self.n = table.column(2).to_numpy()[self.chunk]
        # a word's hash is the polynomial of its bytes, taken from running sums over the whole line
        powers, back = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        word = _mixed((sums[self.ends] - sums[self.starts]) * back[self.starts])
        tongue = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) for x in self.langs], dtype=np.uint64)
        self.words = _mixed(word ^ tongue[self.lang[self.chunk]])

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that start an n-gram of this size which its chunk owns, and the hashes of all starts."""
        if size == 1:
            return np.flatnonzero(self.own), self.words
        count = len(self.words) - size + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.words[:count]
        for i in range(1, size):
            h = _mixed(h * np.uint64(3) + self.words[i : count + i])
        return np.flatnonzero(self.own[:count] & (self.chunk[:count] == self.chunk[size - 1 :])), h

    def weighed(self, places: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes at places, the place of one occurrence of each, and their frequencies."""
        keys, first, back = np.unique(h[places], return_index=True, return_inverse=True)
        return keys, places[first], np.bincount(back, weights=self.n[places], minlength=len(keys)).astype(np.int64)


def _blocks(found: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[Block]:
    """Batches gathered to blocks of about `size` bytes, so that what is frequent gives few rows."""
    held: list[pa.RecordBatch] = []
    for b in found:
        if b.num_rows:
            held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield Block(pa.Table.from_batches(held))
            held = []
    if held:
        yield Block(pa.Table.from_batches(held))


def frequent_hashes(words: DataFrame, size: int, least: int, below: object | None) -> DataFrame:
    """(key): hashes of n-grams of this size, of words that may be frequent by the bitmap below, found `least` times."""

    def counted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(found):
            places, h = block.grams(size)
            if below is not None and len(places):
                fine = in_bitmap(below.value, block.words)
                for i in range(size):
                    places = places[fine[places + i]]
            keys, _, n = block.weighed(places, h)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return words.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key")


def phrase_counts(words: DataFrame, least: int) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of 1 to LONGEST words found `least` times; size 0, phrase '': all words."""
    context = words.sparkSession.sparkContext
    ones = context.broadcast(bitmap(materialize(frequent_hashes(words, 1, least, None), "phrases-words"), "key"))
    twos = context.broadcast(bitmap(materialize(frequent_hashes(words, 2, least, ones), "phrases-pairs"), "key"))

    def counted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(found):
            langs, sizes, said, n = [], [], [], []
            for lang, x in enumerate(np.bincount(block.lang[block.chunk], weights=block.own * block.n).tolist()):
                langs.append(lang), sizes.append(0), said.append(b""), n.append(int(x))
            pairs = block.grams(2)[1]
            fine = in_bitmap(twos.value, pairs) if len(pairs) else np.zeros(0, bool)
            for size in range(1, LONGEST + 1):
                places, h = block.grams(size)
                if size == 1:
                    places = places[in_bitmap(ones.value, h[places])]
                for i in range(size - 1):
                    places = places[fine[places + i]]
                _, first, f = block.weighed(places, h)
                langs += block.lang[block.chunk[first]].tolist()
                sizes += [size] * len(first)
                said += [block.line[s:e].replace(b"\t", b" ") for s, e in zip(block.starts[first].tolist(), block.ends[first + size - 1].tolist())]
                n += f.tolist()
            named = pa.array(block.langs, pa.string()).take(pa.array(langs, pa.int32()))
            yield pa.record_batch([named, pa.array(sizes, pa.int32()), pa.array(said, pa.binary()), pa.array(n, pa.int64())], names=["lang", "size", "phrase", "n"])

    rows = words.mapInArrow(counted, "lang string, size int, phrase binary, n long").select("lang", "size", F.col("phrase").cast("string").alias("phrase"), "n")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | (F.col("size") == 0))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 * a / (left + right)) of longs, exact beyond 64 bits."""
    wide = lambda x: x.cast("decimal(19,0)")
    product, total = F.lit(2_000_000).cast("decimal(8,0)") * wide(a), wide(left) + wide(right)
    return ((product - F.pmod(product, total)) / total).cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, covered: int = 80, top: int = 2000, every: int = 8) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to LONGEST words.

    a, l, r are the frequencies of the phrase and of its parts at the cut of the least score, n all words of the
    language, score floor(2000000 * a / (l + r)). Phrases found less than `least` times are none; one that lies in a
    longer phrase with at least `covered` percent of its frequency goes. A null language is `und`; a null, empty or
    wordless text has no words; repeated rows count each time; an empty table gives an empty one. Of other columns,
    whatever their names, none is read. Ties of the score go by frequency, then by the phrase's bytes. A text of any
    length is read whole; one piece without a trigger is one chunk.
    """
    words = materialize(dictionary(docs, text_col, lang_col, every), "phrases-dictionary")
    counts = materialize(phrase_counts(words, least), "phrases-counts")
    known, total = counts.filter("size > 0").select("lang", "phrase", "f"), counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    found = counts.filter("size > 1").select("lang", "phrase", "size", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    part = lambda begin, length: F.array_join(F.slice("w", begin, length), " ")
    cuts = found.select("lang", "phrase", "size", "w", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")).select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"))
    scored = (
        cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    )
    inner = found.filter("size > 2").select("lang", "size", "w", "a", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k")).select("lang", "w", "a", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("at"))
    around = inner.groupBy("lang", part(F.col("at"), F.col("k")).alias("phrase")).agg(F.max("a").alias("around"))
    hundred, share = F.lit(100).cast("decimal(3,0)"), F.lit(covered).cast("decimal(3,0)")
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (hundred * F.col("around").cast("decimal(19,0)") < share * F.col("a").cast("decimal(19,0)")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), F.asc("phrase")))
    ranked = kept.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").cast("long").alias("score"))
