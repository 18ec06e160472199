"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed length.

Documents become token ids in the tasks that read them; only (document, piece, length) rows move on. They are
dealt by a hash into shards of about `shard_pieces` pieces, each of which has the whole mix of lengths, and a
shard is packed by best-fit decreasing: a segment tree over the remaining capacities names the tightest open
sequence in logarithmic time. A shard leaves at most about one part-filled sequence more than packing it all at
once would, so with thousands of pieces to a shard the loss is far below a thousandth.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, with_row_key

#: A space between two other characters. No token of the byte-level vocabulary spans it from the left.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


#: The runs that a byte-level vocabulary splits a text into, and what keeps a text from being split by them here:
#: characters whose class Python's patterns and the vocabulary's don't share. Longer texts are cut at spaces.
_RUN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile(r"[^\x00-\x1b\x20-\u024f]|[\xb2\xb3\xb9\xbc-\xbe]")
_WHOLE = 1 << 20


class _Unsafe(Exception):
    pass


#: Signs that may follow a word; a run of them is a part of its own in a byte-level vocabulary.
_SIGNS = ".,;:!?*%$&#|"


def _byte_letters() -> dict[int, str]:
    """The printable letter by which a byte-level vocabulary writes each byte: itself where it can be seen, else from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of a text by a byte-level BPE file of the tokenizers library, little-endian unsigned 32-bit.

    Such a vocabulary first splits a text into runs of letters, digits or signs, each with at most one space
    before it. So a text may be cut before a single space between two other characters and its parts encoded
    alone: parts repeat, and those of up to 64 characters are kept, `cached` of them at most. It also bounds
    the memory that a very long text takes. A part of Latin letters alone is one run, which the vocabulary's
    model takes as it is. A text of Latin letters, digits and signs is split into its runs at once, each of which is kept.
    """

    def __init__(self, path: str, cached: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            form = json.load(f)
        before = form["pre_tokenizer"]
        if form["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("texts can be cut at spaces for a plain byte-level vocabulary only")
        self.model, self.cached, self.letters = self.tokenizer.model, cached, _byte_letters()
        self.signs: dict[str, bytes] = {}
        self.added = [t["content"] for t in form.get("added_tokens") or []]
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        outer = self

        class Runs(dict):
            def __missing__(self, run: str) -> bytes:
                return outer.remember_run(self, run)

        self.runs: dict[str, bytes] = Runs()

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                return outer.remember(self, part)

        self.parts: dict[str, bytes] = Parts()

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def remember(self, where: dict, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Unsafe
        word = part.rstrip(_SIGNS)
        tail = part[len(word) :]
        if word.isalpha() and max(word) < "\u0250" and len(part) <= 64:
            if tail:
                if tail not in self.signs:
                    if len(self.signs) >= self.cached:
                        self.signs.clear()
                    self.signs[tail] = self.raw(tail)
                ids = where[word] + self.signs[tail]
            else:
                text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = np.array([t.id for t in self.model.tokenize("\u0120" + text)], dtype="<u4").tobytes()
        else:
            ids = self.raw(" " + part)
        if len(part) <= 64:
            if len(where) >= self.cached:
                where.clear()
            where[part] = ids
        return ids

    def remember_run(self, where: dict, run: str) -> bytes:
        ids = b"".join([self.packed[t.id] for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.letters))])
        if len(run) <= 64:
            if len(where) >= self.cached:
                where.clear()
            where[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(text) <= _WHOLE and not _OTHER.search(text) and not any(t in text for t in self.added):
            return b"".join(map(self.runs.__getitem__, _RUN.findall(text)))
        first, *rest = text.split(" ")
        if not rest:
            return self.raw(first)
        try:
            if not first or first[0].isspace() or first[-1].isspace():
                raise _Unsafe
            return self.raw(first) + b"".join(map(self.parts.__getitem__, rest))
        except _Unsafe:
            first, *rest = _SAFE.split(text)
            # the last part may end in white space
            return self.raw(first) + b"".join(self.raw(" " + p) if p[-1].isspace() else self.parts[p] for p in rest)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, after a first one that takes the remainder."""
    if n <= capacity:
        return [n]
    return [n % capacity][: n % capacity] + [capacity] * (n // capacity)


def id_type(tokenizer_path: str, end_id: int = 0) -> str:
    """The little-endian type that ids are moved in: 16 bits where the vocabulary and end_id fit, else 32."""
    return "<u2" if max(end_id, *encoder(tokenizer_path).tokenizer.get_vocab().values()) < 1 << 16 else "<u4"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, piece int, start long, length long, ids_crc32 long) of every document, and ids, as bytes of id_type(), if asked for.

    A document's ids are those of its whole text (null: none) and end_id. Only a longer one than capacity is
    cut, into full pieces after a first one that may be shorter.
    """
    moved_as = id_type(tokenizer_path, end_id) if with_ids else None

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in found:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                got = encode(text.as_py() or "") + end
                at = 0
                for k, n in enumerate(cut(len(got) // 4, capacity)):
                    part = got[4 * at : 4 * (at + n)]
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(moved_as).tobytes())
                    at += n
            out = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.record_batch(out + [pa.array(ids, pa.binary())] * with_ids, names=["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    ids = docs.schema[id_col].dataType.simpleString()
    schema = f"id {ids}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, schema).withColumnRenamed("id", id_col)


class OpenSequences:
    """Open sequences by what still fits into them, under a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.by_room[room].append(sequence)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The room and number of the tightest sequence with at least so much room, taken out of the tree."""
        i = least + self.size
        if not self.count[i]:
            while i & 1 or not self.count[i + 1]:  # up, until a tree to the right has some
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.size:  # down, to its leftmost
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        sequence = self.by_room[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, sequence


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece; lengths are 1 to capacity."""
    tree = OpenSequences(capacity)
    sequence, offset, made = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            room, number, made = capacity, made, made + 1
        else:
            room, number = found
        sequence[i], offset[i] = number, capacity - room
        if room > n:
            tree.add(room - n, number)
    return sequence, offset


def pack(parts: DataFrame, capacity: int = 2048, shard_pieces: int = 8192, id_col: str = "doc_id") -> DataFrame:
    """Give each piece (with id_col, piece, length and other columns) its sequence_id and offset.

    parts is a written table, so that a task that runs again deals its rows alike. Offsets have no gaps from 0.
    Rows may repeat; each is placed. An empty table gives an empty one.
    """
    shards = max(1, -(-parts.count() // shard_pieces))
    order = [id_col, "piece"]

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        sequence, offset = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["shard"].to_numpy() * np.int64(1 << 32) + sequence, offset=offset).drop(columns="shard")

    # the row's place in the written table spreads rows that repeat
    shard = F.pmod(F.xxhash64(id_col, "piece", F.monotonically_increasing_id()), F.lit(shards))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return parts.withColumn("shard", shard).groupBy("shard").applyInPandas(place, schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, shard_pieces: int = 8192, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Tokenize, cut and pack whole documents; one row for each piece, with where it lies, and with its ids if asked for.

    A null or empty text is a document of one token, end_id. Rows with a null id, and repeated rows, are packed
    like any other. Rows that repeat spread over the shards.
    """
    if not with_ids:
        return pack(materialize(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces"), capacity, shard_pieces, id_col)
    parts, key = with_row_key(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, True), "pieces")
    # only lengths are packed; the ids join where they lie, streamed past the short rows and not sorted, at any size
    placed = pack(parts.drop("ids"), capacity, shard_pieces, id_col).hint("shuffle_hash")
    joined = parts.select(key, "ids").join(placed, key).select(*(c for c in placed.columns if c != key), "ids")
    moved_as = id_type(tokenizer_path, end_id)

    def opened(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                raw = part.column(part.num_columns - 1).to_pylist()
                ids = np.frombuffer(b"".join(raw), dtype=moved_as).astype(np.int32)
                ends = np.cumsum([0] + [len(x) // int(moved_as[-1]) for x in raw]).astype(np.int32)
                yield pa.record_batch([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=part.schema.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1]) + ", ids array<int>"
    return joined.mapInArrow(opened, schema)
