"""Prefix trie of conversations: double-array tries of prefix shards, and shared upper nodes merged globally.

Equal conversations are one sequence of turn keys first. Sequences that share their first turns lie in one shard; a
prefix that too many sequences have is told apart by twice as many turns, so a first turn that a third of all
conversations share is spread over many shards. A shard packs its sequences into one double array over its own
dense turn ids: the child of state s by turn c is the state BASE[s] + c, if CHECK there names s. Walking the arrays
with each sequence gives its nodes. All that hangs below a shard's prefix lies in the shard; only the nodes above it
can lie in several, and these alone are merged by the digest of their path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_unhot, materialize, n_words

ROOT = "root"


class DoubleArray:
    """A trie over sequences of dense ids from 1 on. State 0 is the root; slot i is taken if CHECK[i] >= 0 or i is 0."""

    def __init__(self, sequences: list[list[int]]):
        self.base, self.check, self._next = [0], [0], [1]
        self.order: list[int] = [0]  # states, parents before children
        ordered = sorted(sequences)
        todo = [(0, 0, len(ordered), 0)]
        for state, low, high, depth in todo:
            while low < high and len(ordered[low]) == depth:
                low += 1
            runs = []
            while low < high:
                code, end = ordered[low][depth], low
                while end < high and ordered[end][depth] == code:
                    end += 1
                runs.append((code, low, end))
                low = end
            if runs:
                self.base[state] = self._room([r[0] for r in runs])
                for code, a, b in runs:
                    slot = self.base[state] + code
                    self._take(slot, state)
                    self.order.append(slot)
                    todo.append((slot, a, b, depth + 1))

    def _free(self, i: int) -> int:
        """The first free slot from i on."""
        self._grow(i + 1)
        path = []
        while i < len(self._next) and self._next[i] != i:
            path.append(i)
            i = self._next[i]
        for p in path:
            self._next[p] = i
        self._grow(i + 1)
        return i

    def _grow(self, size: int) -> None:
        while len(self.check) < size:
            self._next.append(len(self.check))
            self.check.append(-1)
            self.base.append(0)

    def _room(self, codes: list[int], tries: int = 64) -> int:
        """A base at which all codes' slots are free: among the first free places, else behind the last slot."""
        slot = 0
        for _ in range(tries):
            slot = self._free(slot + 1)
            b = slot - codes[0]
            if all(b + c >= len(self.check) or self.check[b + c] < 0 for c in codes[1:]):
                return b
        return len(self.check) - codes[0]

    def _take(self, slot: int, state: int) -> None:
        self._grow(slot + 1)
        self.check[slot] = state
        self._next[slot] = slot + 1

    def child(self, state: int, code: int) -> int:
        """The state that this turn leads to, or -1."""
        slot = self.base[state] + code
        return slot if 0 < slot < len(self.check) and self.check[slot] == state else -1

    def walk(self, sequence: list[int]) -> Iterator[int]:
        """The states of a sequence, root first, as far as there are any."""
        state = 0
        while True:
            yield state
            sequence = sequence if isinstance(sequence, Iterator) else iter(sequence)
            code = next(sequence, None)
            state = -1 if code is None else self.child(state, code)
            if state < 0:
                return


def turn_key(role: Column, text: Column) -> Column:
    """What tells turns apart: 128 bits of a digest of role and text, as hex."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def turns_in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns, by turn (null first) and then by key, as structs of key and words.

    A null role or text is empty; rows without conv_id belong to no conversation. A conversation is one row of about
    50 bytes a turn, without texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), turn_key(role, text).alias("key"), n_words(text).alias("words"))
    made = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return made.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"], t["words"])).alias("turns"))


def with_shared_heads(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin as the one whose id is theirs without the remainder by `every` does.

    The first h turns come from there (all it has, if fewer; none, if there is no such), the rest are their own after
    their first h; h is crc32 of the id in decimal, modulo `most`.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    told = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    return told.select("conv_id", F.concat(F.coalesce(F.slice("head", 1, F.col("h")), none), F.slice("turns", F.col("h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("h")))).alias("turns"))


def _ends(convs: DataFrame) -> DataFrame:
    """(seq, ends_sha256) of each sequence: ids are streamed into the digest in order, none are gathered."""

    def digested(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in found:
            seqs, said = [], []
            for seq, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if seq == now:
                    state.update(b",%d" % i)
                else:
                    if now is not None:
                        seqs.append(now), said.append(state.hexdigest())
                    now, state = seq, hashlib.sha256(b"%d" % i)
            yield pa.record_batch([pa.array(seqs, pa.string()), pa.array(said, pa.string())], names=["seq", "ends_sha256"])
        if now is not None:
            yield pa.record_batch([pa.array([now]), pa.array([state.hexdigest()])], names=["seq", "ends_sha256"])

    return convs.select("seq", F.col("conv_id").cast("long").alias("conv_id")).repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(digested, "seq string, ends_sha256 string")


def _prefix(k: int) -> Column:
    return F.xxhash64(F.slice("keys", 1, k))


def _shards(sequences: DataFrame, split_above: int) -> DataFrame:
    """sequences with k, the turns of the prefix that tells their shard, and bucket: shards share tasks of about split_above turns."""
    rest, k, placed = sequences, 1, []
    while True:
        sizes = materialize(rest.groupBy(_prefix(k).alias("prefix")).agg(F.sum(F.size("keys")).alias("turns"), F.count("*").alias("n")), "trie-prefixes")
        deep = (F.col("turns") > split_above) & (F.col("n") > 1)
        large, turns = sizes.agg(F.count(F.when(deep, 1)), F.sum("turns")).first()
        tasks = max(1, -(-(turns or 0) // split_above))
        here = rest.withColumn("prefix", _prefix(k)).withColumn("k", F.lit(k)).withColumn("bucket", F.pmod("prefix", F.lit(tasks)))
        if not large:
            placed.append(here.drop("prefix"))
            break
        told = materialize(join_unhot(here, sizes.select("prefix", deep.alias("deep"), "n").withColumnRenamed("n", "sequences"), "prefix", "sequences"), "trie-told")
        placed.append(told.filter("not deep").drop("prefix", "deep"))
        rest, k = told.filter("deep").select(sequences.columns), 2 * k
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out


_NODE = "upper boolean, conv_id long, depth long, path string, trail array<string>, parent_path string, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, seq string"


def _shard_nodes(group: pa.Table) -> pa.Table:
    """Nodes of one group of shards, from its double array. Nodes above the prefixes are `upper`: their sums are parts."""
    k = group.column("k")[0].as_py()
    keys = group.column("keys").to_pylist()
    ids = {key: i + 1 for i, key in enumerate(sorted({x for s in keys for x in s}))}
    sequences = [[ids[x] for x in s] for s in keys]
    trie = DoubleArray(sequences)
    size = len(trie.check)
    n_convs, least, seq, words, key_of = [0] * size, [None] * size, [None] * size, [0] * size, [""] * size
    for s, said, n, low, name, w in zip(sequences, keys, group.column("n").to_pylist(), group.column("least").to_pylist(), group.column("seq").to_pylist(), group.column("words").to_pylist()):
        state = 0
        for i, state in enumerate(trie.walk(s)):
            n_convs[state] += n
            least[state] = low if least[state] is None else min(low, least[state])
            if i:
                words[state], key_of[state] = w[i - 1], said[i - 1]
        seq[state] = name
    depth, path, trail = [0] * size, [ROOT] * size, [[ROOT]] * size
    for t in trie.order[1:]:
        up = trie.check[t]
        depth[t] = depth[up] + 1
        if depth[t] <= k:
            path[t] = hashlib.sha256((path[up] + key_of[t]).encode()).hexdigest()[:32]
            trail[t] = [*trail[up], path[t]]
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for t in reversed(trie.order):
        if depth[t] >= k:
            leaves[t] += not children[t]
            saved[t] += (n_convs[t] - 1) * words[t]
        if t:
            up = trie.check[t]
            children[up] += 1
            leaves[up] += leaves[t]
            saved[up] += saved[t]
    out = [
        (depth[t] < k, least[t], depth[t], path[t] if depth[t] < k else None, trail[t] if depth[t] < k else None, path[trie.check[t]] if t and depth[t] <= k else None,
         least[trie.check[t]] if depth[t] > k else None, n_convs[t], children[t], leaves[t], saved[t], words[t], seq[t])
        for t in trie.order
    ]
    columns = list(zip(*out))
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, _KINDS)], names=[f.split()[0] for f in _NODE.split(", ")])


_KINDS = [{"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[f.split()[1]] for f in _NODE.split(", ")]


def prefix_nodes(convs: DataFrame, split_above: int = 200_000) -> DataFrame:
    """Nodes of the prefix trie of convs (conv_id, turns: array of structs of key string and words long).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), as longs but for the
    last: a node is a distinct sequence of first turns, named by the least id of the conversations that begin so, and
    its depth. Turnless conversations end at the root, whose parent is null. saved_tokens sums (n_convs - 1) * words
    of the last turn over the subtree. An empty table has no node. Ids are told apart as they come: one row each.
    """
    keyed = convs.select("conv_id", F.transform("turns", lambda t: t["key"]).alias("keys"), F.transform("turns", lambda t: t["words"]).alias("words")).withColumn("seq", F.sha2(F.array_join("keys", ""), 256))
    keyed = materialize(keyed, "trie-conversations")
    distinct = materialize(keyed.groupBy("seq").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("words").alias("words")), "trie-sequences")
    dealt = _shards(distinct.filter(F.size("keys") > 0), split_above)
    nodes = materialize(dealt.groupBy("k", "bucket").applyInArrow(_shard_nodes, _NODE), "trie-nodes")

    zero = F.lit(0).cast("long")
    turnless = distinct.filter(F.size("keys") == 0).select(
        F.lit(True).alias("upper"), F.col("least").alias("conv_id"), zero.alias("depth"), F.lit(ROOT).alias("path"), F.array(F.lit(ROOT)).alias("trail"), F.lit(None).cast("string").alias("parent_path"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), zero.alias("words"), "seq",
    )
    whole = nodes.filter("not upper")
    parts = nodes.filter("upper").unionByName(turnless)
    merged = materialize(
        parts.groupBy("path").agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.first("trail").alias("trail"), F.max("parent_path").alias("parent_path"), F.sum("n_convs").alias("n_convs"),
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("words").alias("words"), F.max("seq").alias("seq"),
        ),
        "trie-upper",
    )
    kids = merged.select("parent_path").unionByName(whole.select("parent_path")).filter("parent_path is not null").groupBy("parent_path").agg(F.count("*").alias("n_children"))
    counted = materialize(merged.join(kids.withColumnRenamed("parent_path", "path"), "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-counted")
    added = counted.select(F.explode("trail").alias("path"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    sums = added.groupBy("path").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    parent = counted.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("kids"))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "seq"]
    upper = (
        counted.join(sums, "path")
        .withColumn("n_leaves", F.col("n_leaves") + F.col("leaf"))
        .withColumn("saved_tokens", F.col("saved_tokens") + F.col("own"))
        .join(parent.drop("kids"), "parent_path", "left")
        .select(shown)
    )
    below = join_unhot(whole.filter("parent_path is not null").drop("parent_conv_id"), parent, "parent_path", "kids").select(shown)
    every = upper.unionByName(below).unionByName(whole.filter("parent_path is null").select(shown))
    ended = every.filter("seq is not null").join(_ends(keyed), "seq")
    open_ = every.filter("seq is null").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return ended.unionByName(open_, allowMissingColumns=True).select(*shown[:-1], "ends_sha256")
