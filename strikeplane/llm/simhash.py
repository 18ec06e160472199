"""SimHash near-duplicates: pigeonhole blocks of fingerprints, joined and then verified by Hamming distance.

A fingerprint is cut into `blocks` blocks of bits. Two that differ in at most d bits agree in at least
blocks - d whole blocks, so each is filed under every choice of blocks - d blocks, and close pairs meet under
at least one. With seven blocks and d = 4 a file's key has 27 bits, so fingerprints that have nothing in common
rarely meet, and the files grow as the documents do.

Equal fingerprints are one node before anything is filed. Inside a file no pairs are listed: a breadth-first
walk finds what hangs together and gives one edge for each node but the first. A file with more than
`split_above` nodes is dealt out again, every two of its chunks to a task, so its links are all found and no
task holds it whole.

For near copies by the Jaccard similarity of shingle sets 64 bits are too few: at 0.8, pairs differ in 15 percent
of the bits. similar() and keep_one() take fingerprints of 512 bits, whose blocks grow in length and number with
the documents: close pairs share a block, meet there, and are verified by Hamming distance. What so hangs together
is compared by the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .parts import Radius, part_keys
from .shared import bitmap, in_bitmap, join_unhot, materialize, with_row_key

BITS = 64
_POWERS = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))


def fingerprint(text: str | None, shingle_words: int, seed: int) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(last), 16384):  # a very long text needs no more memory than this many shingles
        hashes = np.fromiter((digest(line[s:e], seed) for s, e in zip(starts[at : at + 16384], last[at : at + 16384])), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(_POWERS[2 * total > len(last)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, seed: int = 42) -> DataFrame:
    """(id_col, fp long) of every document: repeated word shingles, lower-cased A-Z, hashed by XXH64.

    A bit is set if more than half of the hashes have it. A text of fewer words is one shingle; a null or empty
    one has fingerprint 0. Other columns, whatever their names, are not read.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            got = np.fromiter((fingerprint(t.as_py(), shingle_words, seed) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(got.view(np.int64))], names=["id", "fp"])

    ids = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, f"id {ids}, fp long").withColumnRenamed("id", id_col)


def block_masks(blocks: int, max_distance: int) -> list[int]:
    """The bits of each file's key: every choice of blocks - max_distance blocks."""
    if not max_distance < blocks <= BITS:
        raise ValueError("there must be more blocks than differing bits")
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_distance)]


def forest(fps: np.ndarray, max_distance: int) -> tuple[list[int], list[int]]:
    """Edges that hold together whatever is linked within distinct fps: one for each node reached."""
    a: list[int] = []
    b: list[int] = []
    rest = np.sort(fps)
    while len(rest) > 1:
        todo, rest, first = [rest[0]], rest[1:], int(rest[0])
        while todo and len(rest):
            near = np.bitwise_count((rest ^ todo.pop()).view(np.uint64)) <= max_distance
            if near.any():
                got = rest[near]
                rest = rest[~near]
                todo.extend(got)
                a.extend([first] * len(got))
                b.extend(got.tolist())
    return a, b


def links(nodes: DataFrame, max_distance: int = 4, blocks: int = 7, split_above: int = 8192) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) that connect exactly what chains of close pairs connect."""
    masks = block_masks(blocks, max_distance)
    mask_of = np.array(masks, dtype=np.uint64).view(np.int64)
    filed = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(int(m))).alias("k")) for c, m in enumerate(mask_of.tolist())))).alias("f")).select("f.c", "f.k", "fp")
    dealt = filed.repartition("c", "k").sortWithinPartitions("c", "k", "fp")

    def walk(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: list[int], b: list[int], c: int | None = None) -> pa.RecordBatch:
            return pa.record_batch([pa.array([c] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["c", "a", "b"])

        kept: tuple | None = None  # (c, k, arrays of fp, their length, whether it overflowed) of the run that may go on
        for batch in found:
            if not batch.num_rows:
                continue
            c, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(c)]])
            a_out: list[int] = []
            b_out: list[int] = []
            runs = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(c)))
            for i in runs.tolist():
                s, e = int(starts[i]), int(ends[i])
                key, part, over = (int(c[s]), int(k[s])), fp[s:e], False
                if kept is not None and s == 0:
                    if kept[0] == key:
                        part, over = np.concatenate([kept[1], part]), kept[2]
                    elif not kept[2]:
                        a, b = forest(kept[1], max_distance)
                        a_out += a
                        b_out += b
                    kept = None
                if over or len(part) > split_above:
                    yield out([key[1]] * len(part), part.tolist(), key[0])
                    part, over = part[:0], True
                if e == len(c):
                    kept = (key, part, over)
                elif not over:
                    a, b = forest(part, max_distance)
                    a_out += a
                    b_out += b
            if a_out:
                yield out(a_out, b_out)
        if kept is not None and not kept[2]:
            yield out(*forest(kept[1], max_distance))

    first = materialize(dealt.mapInArrow(walk, "c int, a long, b long"), "simhash-links")
    edges = first.filter("c is null").select("a", "b")
    large = first.filter("c is not null").select("c", F.col("a").alias("k"), F.col("b").alias("fp"))
    sizes = large.groupBy("c", "k").agg(F.ceil(F.count("*") / split_above).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = (
        large.join(sizes, ["c", "k"])
        .withColumn("own", own)
        .select("c", "k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("c", "k", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def walk_pair(group: pa.Table) -> pa.Table:
        a, b = forest(np.unique(group.column("fp").to_numpy()), max_distance)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return edges.unionByName(pairs.groupBy("c", "k", "i", "j").applyInArrow(walk_pair, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_distance: int = 4, blocks: int = 7, seed: int = 42, split_above: int = 8192) -> DataFrame:
    """(id_col, fp long, component) of every document.

    component is the smallest id that chains of links reach, the document's own included; fingerprints link if
    at most max_distance bits differ. Null and empty texts have fingerprint 0 and link like any other. Rows
    with a null id keep their own row; they never give a component its id, and a component of null ids alone
    has a null one. Rows that repeat an id give one row each. An empty table gives an empty one.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words, seed), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "simhash-nodes")
    reached = components(links(nodes.select("fp"), max_distance, blocks, split_above))
    placed = materialize(nodes.join(reached, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label"), "least", "n"), "simhash-placed")
    least = placed.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("members"))
    named = join_unhot(placed.drop("least"), least, "label", "members").select("fp", "component", "n")
    return join_unhot(prints, named, "fp", "n").select(id_col, "fp", "component")


def shingle_set(text: str | None, shingle_words: int, seed: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, as fingerprint() cuts and hashes them; none for a null or empty text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e], seed) for s, e in zip(starts, last)), dtype=np.uint64, count=len(last)))


#: 64-bit words of a wide fingerprint, and how many of them go along to verify a pair that shares a block.
WIDE, SKETCH = 8, 3


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Bits, 0 or 1, of a set of hashes: 1 if set in over half of them. Each further word of a hash is its mixed self."""
    total = np.zeros(BITS * WIDE, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096, None] + np.arange(WIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return (2 * total > len(hashes)).astype(np.uint8)


def differing(similarity: float) -> float:
    """The share of fingerprint bits in which two sets of this Jaccard similarity differ on average, at most.

    Bits are signs of sums over the sets, so it is the angle between the sets over pi, and sets of one size are the
    widest apart: for sets so large that few sums tie. Where a small set's sums tie, more bits differ.
    """
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def block_plan(nodes: int, similarity: float, miss: float = 0.03, load: int = 256) -> tuple[int, int]:
    """Bits of a block and number of blocks, for so many fingerprints.

    A block is as long as it takes for about `load` unrelated fingerprints to share its bits; there are so many
    that a pair right at the similarity shares none with the chance `miss`, taken over the differing bits that
    such pairs have. The number of blocks grows as about the fourth root of the fingerprints.
    """
    bits = max(8, math.ceil(math.log2(max(2, nodes) / load)))
    q, width = differing(similarity), BITS * WIDE
    differ = np.arange(width + 1)
    log_chance = np.array([math.lgamma(width + 1) - math.lgamma(d + 1) - math.lgamma(width - d + 1) for d in differ]) + differ * math.log(q) + (width - differ) * math.log1p(-q)
    agree = (1 - differ / width) ** bits
    low, high = 1, 1 << 20
    while low < high:
        blocks = (low + high) // 2
        low, high = (low, blocks) if (np.exp(log_chance) * (1 - agree) ** blocks).sum() <= miss else (blocks + 1, high)
    return bits, low


def block_keys(prints: np.ndarray, bits: int, blocks: int, seed: int) -> np.ndarray:
    """A key for each row and block: the block's number and its bits.

    The bits of a fingerprint are split into blocks as they lie, then again in one drawn order after another
    until there are enough.
    """
    rng, width = np.random.default_rng(seed), prints.shape[1]
    each = width // bits
    places = np.concatenate([rng.permutation(width)[: each * bits].reshape(each, bits) for _ in range(-(-blocks // each))])[:blocks]
    out = np.empty((len(prints), blocks), dtype=np.int64)
    for j, place in enumerate(places):
        out[:, j] = prints[:, place] @ (np.int64(1) << np.arange(bits, dtype=np.int64)) + (np.int64(j) << bits)
    return out


def sketch_forest(rows: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Edges, by place, that hold together what is linked within rows of 64-bit words."""
    a: list[int] = []
    b: list[int] = []
    rest = np.arange(len(rows))
    while len(rest) > 1:
        first, todo, rest = int(rest[0]), [int(rest[0])], rest[1:]
        while todo and len(rest):
            near = np.bitwise_count(rows[rest] ^ rows[todo.pop()]).sum(axis=1, dtype=np.int32) <= most
            if near.any():
                got = rest[near].tolist()
                rest = rest[~near]
                todo += got
                a += [first] * len(got)
                b += got
    return a, b


def runs_with_close_rows(starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, most: int, small: int = 512) -> np.ndarray:
    """Numbers of the runs that hold two close rows; runs above `small` rows are named unseen."""
    size = ends - starts
    if not len(size):
        return size
    first, run = int(starts[0]), np.repeat(np.arange(len(starts)), size)
    found = size > small
    for shift in range(1, int(size[~found].max(initial=1))):
        i = np.flatnonzero((run[shift:] == run[:-shift]) & ~found[run[shift:]])
        for part in np.array_split(i, max(1, len(i) // 65536)):
            part = part + first
            near = np.bitwise_count(rows[part] ^ rows[part + shift]).sum(axis=1, dtype=np.int32) <= most
            found[run[part[near] - first]] = True
    return np.flatnonzero(found)


def block_links(filed: DataFrame, most: int, split_above: int = 4096) -> DataFrame:
    """Edges (a, b) over filed (k, node, w0, w1, w2 longs) that connect exactly what chains of close rows of one k connect.

    Rows of a k are walked as links() does. A k of more than split_above rows is dealt out again, every two of
    its chunks to a task.
    """
    words = [f"w{i}" for i in range(SKETCH)]
    dealt = filed.select("k", "node", *words).repartition("k").sortWithinPartitions("k", "node")
    names = ["k", "a", "b", *words]

    def edges_of(node: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        a, b = sketch_forest(rows, most)
        return pa.record_batch([pa.nulls(len(a), pa.int64()), pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64()), *(pa.nulls(len(a), pa.int64()) for _ in words)], names=names)

    def again(k: int, node: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([k] * len(node), pa.int64()), pa.array(node), pa.nulls(len(node), pa.int64()), *(pa.array(rows[:, i].view(np.int64)) for i in range(SKETCH))], names=names)

    def walk(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None  # k, nodes, rows of the run that may go on; no rows once it is dealt out
        for batch in found:
            if not batch.num_rows:
                continue
            k, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = np.stack([batch.column(2 + i).to_numpy() for i in range(SKETCH)], axis=1).view(np.uint64)
            over = False
            if kept is not None:
                if kept[0] == k[0]:
                    over = not len(kept[1])
                    k, node, rows = np.concatenate([np.full(len(kept[1]), k[0]), k]), np.concatenate([kept[1], node]), np.concatenate([kept[2], rows])
                elif len(kept[1]) > 1:
                    yield edges_of(kept[1], kept[2])
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
            if over:
                yield again(int(k[0]), node[: ends[0]], rows[: ends[0]])
            last = int(starts[-1])
            inner = slice(1 if over else 0, len(starts) - 1)
            for r in runs_with_close_rows(starts[inner], ends[inner], rows, most).tolist():
                s, e = int(starts[inner][r]), int(ends[inner][r])
                yield again(int(k[s]), node[s:e], rows[s:e]) if e - s > split_above else edges_of(node[s:e], rows[s:e])
            dealt_out = over and len(starts) == 1
            if not dealt_out and len(k) - last > split_above:
                yield again(int(k[-1]), node[last:], rows[last:])
                dealt_out = True
            kept = (k[-1], node[:0], rows[:0]) if dealt_out else (k[-1], node[last:].copy(), rows[last:].copy())
        if kept is not None and len(kept[1]) > 1:
            yield edges_of(kept[1], kept[2])

    first = materialize(dealt.mapInArrow(walk, "k long, a long, b long, " + ", ".join(f"{w} long" for w in words)), "simhash-block-links")
    large = first.filter("k is not null").select("k", F.col("a").alias("node"), *words)
    sizes = large.groupBy("k").agg(F.ceil(F.count("*") / split_above).cast("int").alias("parts"), F.count("*").alias("n"))
    pairs = (
        join_unhot(large, sizes, "k", "n")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("k", "node", *words, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def walk_pair(group: pa.Table) -> pa.Table:
        node, at = np.unique(group.column("node").to_numpy(), return_index=True)
        rows = np.stack([group.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
        a, b = sketch_forest(rows[at], most)
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    return first.filter("k is null").select("a", "b").unionByName(pairs.groupBy("k", "i", "j").applyInArrow(walk_pair, "a long, b long")).distinct()


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges, by place, that hold together exactly what chains of sets of at least this Jaccard similarity connect.

    Sets lie in order of size, so a set meets only those whose size allows the similarity; whoever is reached
    leaves, so a group of copies makes no pairs.
    """
    a: list[int] = []
    b: list[int] = []
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    place = np.argsort(sizes, kind="stable")
    place = place[sizes[place] > 0]
    if len(place) < 2:
        return a, b
    words, flat = np.unique(np.concatenate([sets[i] for i in place]), return_inverse=True)
    mark = np.zeros(len(words), dtype=bool)
    size = sizes[place]
    starts = np.concatenate([[0], np.cumsum(size)])
    alive = np.ones(len(place), dtype=bool)
    n_alive = len(place)
    while n_alive:
        at = int(np.argmax(alive))
        alive[at] = False
        n_alive -= 1
        first, todo = int(place[at]), [flat[starts[at] : starts[at + 1]]]
        while todo and n_alive:
            own = todo.pop()
            lo = int(np.searchsorted(size, math.floor(len(own) * similarity)))
            hi = int(np.searchsorted(size, math.ceil(len(own) / similarity), side="right"))
            if lo < hi and alive[lo:hi].any():
                mark[own] = True
                shared = np.add.reduceat(mark[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
                mark[own] = False
                near = np.flatnonzero(alive[lo:hi] & (shared / (size[lo:hi] + len(own) - shared) >= similarity)) + lo
                for i in near.tolist():
                    todo.append(flat[starts[i] : starts[i + 1]])
                    a.append(first)
                    b.append(int(place[i]))
                alive[near] = False
                n_alive -= len(near)
            if n_alive < len(alive) // 2:  # those that left are looked at no more
                flat = flat[np.repeat(alive, size)]
                place, size = place[alive], size[alive]
                starts = np.concatenate([[0], np.cumsum(size)])
                alive = np.ones(n_alive, dtype=bool)
    return a, b


def dealt_out(members: DataFrame, split_above: int) -> DataFrame:
    """members (label, node, n) with the tasks (u, i, j) in which a node's set meets others of its label.

    Labels share tasks of about split_above hashes. A label with more is dealt out by node, every two of its
    chunks to a task, so all its pairs are compared and no task holds it whole.
    """
    totals = members.groupBy("label").agg(F.ceil(F.sum("n") / split_above).cast("int").alias("parts"), F.count("*").alias("members"))
    everything, total = members.agg(F.sum("n"), F.count("*")).first()
    tasks = max(1, math.ceil((everything or 0) / split_above))
    sized = join_unhot(members.select("label", "node"), totals, "label", "members", total)
    few = sized.filter("parts <= 1").select(F.pmod(F.xxhash64("label"), F.lit(tasks)).alias("u"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "label", "node")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    many = (
        sized.filter("parts > 1")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .filter("own <> other")
        .select(F.col("label").alias("u"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "label", "node")
    )
    return few.unionByName(many)


def jaccard_links(members: DataFrame, sets: DataFrame, similarity: float, split_above: int = 2_000_000) -> DataFrame:
    """Edges (a, b) within each label of members (label, node, n: the size of its set) as of jaccard_forest().

    sets is (row, hashes binary) and has at least the members' nodes. Tasks are dealt before sets join, so these
    are shuffled to their nodes and to their tasks, no more.
    """
    tasks = materialize(dealt_out(members, split_above), "simhash-tasks")

    def walk(group: pa.Table) -> pa.Table:
        label, node = group.column("label").to_numpy(), group.column("node").to_numpy()
        found = [np.frombuffer(x.as_py(), dtype="<u8") for x in group.column("hashes")]
        order = np.argsort(label, kind="stable")
        a_out: list[int] = []
        b_out: list[int] = []
        for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            a, b = jaccard_forest([found[i] for i in part], similarity)
            a_out += node[part[a]].tolist()
            b_out += node[part[b]].tolist()
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    met = sets.join(tasks, F.col("row") == F.col("node")).select("u", "i", "j", "label", "node", "hashes")
    return met.groupBy("u", "i", "j").applyInArrow(walk, "a long, b long")


#: Sets of fewer shingles meet by parts of the sets themselves: their bits tie often, and up to 0.19 of them differ. From
#: 32 shingles on at most 0.154 do, where differing() says 0.151.
SMALL = 32
#: Bits of SKETCH words, out of 192, in which two small sets of at least 0.8 differ at most: 0.19 of them on average, and over four deviations.
SMALL_MOST = 60


def alike(rows: DataFrame, shingle_words: int = 5, similarity: float = 0.8, seed: int = 42, split_above: int = 2_000_000, miss: float = 0.03) -> tuple[DataFrame, DataFrame]:
    """Nodes and groups of rows (row long, each its own, text, and others).

    Nodes are (node, digest, n, first): the least row of each set of shingles, told apart by 128 bits, the number
    of rows that have it, and what `first` (a struct or long of the rows) is least among them. Groups are (node,
    label) of nodes that chains of similar texts connect; a node without any has no row there.

    Texts link whose sets of shingles have a Jaccard similarity of at least `similarity`, by the sets themselves.
    Candidates share a block of their wide fingerprints (block_plan()) and differ in few enough of SKETCH words
    that one pair in 200 at the similarity is lost there. Sets of fewer than SMALL shingles, and those that can be
    alike to one, are filed under parts of the sets (part_keys()), of which every pair at the similarity shares one,
    and lose practically none to the sketch. Null and empty texts are one node.
    """
    radius = Radius(math.floor(100 * similarity))
    widest = radius.partner(SMALL)

    def printed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            sets = [shingle_set(t.as_py(), shingle_words, seed) for t in b.column(2)]
            digest = [xxhash.xxh128_digest(x.astype("<u8").tobytes(), seed) for x in sets]
            prints = [np.packbits(wide_fingerprint(x), bitorder="little").tobytes() for x in sets]
            keys = [part_keys(x, radius).view(np.int64) if len(x) <= widest else None for x in sets]
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["row", "first", "digest", "hashes", "fp", "keys"]
            )

    kind = rows.schema["first"].dataType.simpleString()
    prints = materialize(rows.select("row", "first", "text").mapInArrow(printed, f"row long, first {kind}, digest binary, hashes long, fp binary, keys array<long>"), "simhash-wide")
    # equal sets have equal fingerprints
    nodes = materialize(prints.groupBy("digest").agg(F.min("row").alias("node"), F.min("first").alias("first"), F.count("*").alias("n"), F.first("hashes").alias("hashes"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "simhash-wide-nodes")
    wide = nodes.filter(F.col("hashes") >= SMALL)
    bits, blocks = block_plan(wide.count(), similarity, miss)
    q = differing(similarity)
    most = math.ceil(q * SKETCH * BITS + 2.6 * math.sqrt(q * (1 - q) * SKETCH * BITS))

    def filed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                keys = block_keys(np.unpackbits(raw, axis=1, bitorder="little"), bits, blocks, seed)
                sketch = raw[:, : 8 * SKETCH].copy().view("<i8")
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), blocks)), *(pa.array(np.repeat(sketch[:, i], blocks)) for i in range(SKETCH))], names=["k", "node", *(f"w{i}" for i in range(SKETCH))])

    met = wide.select("node", "fp").mapInArrow(filed, "k long, node long, " + ", ".join(f"w{i} long" for i in range(SKETCH)))
    word = lambda i: F.conv(F.hex(F.substring("fp", 8 * i + 1, 8)), 16, -10).cast("long")
    small = nodes.filter(F.size("keys") > 0).select(F.explode("keys").alias("k"), "node", *(word(i).alias(f"w{i}") for i in range(SKETCH)))
    links = block_links(met, most).unionByName(block_links(small, SMALL_MOST))
    groups = materialize(components(links), "simhash-groups")
    known = rows.sparkSession.sparkContext.broadcast(bitmap(groups.select(F.xxhash64("node").alias("key")), "key"))

    def hashed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            kept = np.flatnonzero(in_bitmap(known.value, b.column(1).to_numpy()))
            sets = [shingle_set(b.column(2)[i].as_py(), shingle_words, seed) for i in kept.tolist()]
            yield pa.record_batch([b.column(0).take(pa.array(kept)), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], names=["row", "hashes"])

    # sets of candidates alone are made and shuffled, texts are not
    sets = rows.select("row", F.xxhash64("row").alias("key"), "text").mapInArrow(hashed, "row long, hashes binary")
    members = materialize(groups.join(nodes.select("node", F.col("hashes").alias("n")), "node").select("label", "node", "n"), "simhash-members")
    return nodes.drop("fp", "hashes", "keys"), components(jaccard_links(members, sets, similarity, split_above))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id_col, component) of every document, as near_duplicates(), for texts alike() by Jaccard similarity of shingles.

    No pair below the similarity is linked; of pairs of SMALL shingles or more right at it, about four in a hundred meet nowhere.
    """
    keyed, key = with_row_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "simhash-rows")
    nodes, groups = alike(keyed.select(F.col(key).alias("row"), F.col("id").alias("first"), "text"), **how)
    placed = materialize(nodes.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node")), "simhash-placed")
    least = placed.groupBy("label").agg(F.min("first").alias("component"), F.count("*").alias("members"))
    named = join_unhot(placed.select("label", "digest", "n"), least, "label", "members").select("digest", "component", "n")
    shingle_words, seed = how.get("shingle_words", 5), how.get("seed", 42)

    def digests(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            sets = [shingle_set(t.as_py(), shingle_words, seed) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([xxhash.xxh128_digest(x.astype("<u8").tobytes(), seed) for x in sets], pa.binary())], names=["id", "digest"])

    kind = keyed.schema["id"].dataType.simpleString()
    told = materialize(keyed.select("id", "text").mapInArrow(digests, f"id {kind}, digest binary"), "simhash-told")
    return join_unhot(told, named, "digest", "n").select(F.col("id").alias(id_col), "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents, all columns, without those that another row stands for.

    Each row is a document of its own, named by a key that is written before anything else. Of each component of
    alike() the row of the smallest id stays, null last, and of rows that repeat this id the one of the smallest
    key. An empty table gives an empty one.
    """
    keyed, key = with_row_key(docs, "simhash-rows")
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key).alias("row"))
    nodes, groups = alike(keyed.select(F.col(key).alias("row"), first.alias("first"), F.col(text_col).alias("text")), **how)
    placed = nodes.join(groups, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first"))
    stay = materialize(placed.select(F.col("first.row").alias("__stays")), "simhash-stay")
    # texts are streamed past the keys that stay, and not sorted: the same plan at any size
    return keyed.join(stay.hint("shuffle_hash"), keyed[key] == stay["__stays"], "left_semi").select(docs.columns)
