"""Exact joins of word-shingle sets in the Jaccard metric, by pivots, Voronoi regions and triangle-inequality windows.

Strangers share no shingle: they lie at distance 1 from each other and from nearly every document that could be a
pivot, so windows around documents alone would copy everything everywhere. The first level therefore takes its
regions in projections. A set's shingles are dealt by a hash to m parts, more than the t shingles in which a pair
within the radius can differ at that size; so a close pair agrees in some part as a whole. Every distinct part set is
a pivot of that part's projection, and its region holds the documents at distance 0 from it; any window that the
radius asks for is empty, as m is chosen so. What regions with a document in common hold together is a region of the
whole space: regions differ from each other by more than the radius, so no document lies in two.

Within such a region pivots are documents. Every document goes to the region of its nearest pivot, and also to each
region whose pivot is no farther than its nearest plus twice the radius: a close pair meets in the region of either.
Documents within the radius of a pivot are linked to it, and need no comparison with each other; those that lie too
near the pivot for anybody outside that ball to reach them leave. Regions are split again in the same way, over all
tasks while they are large and then inside one. A region that pivots do not make smaller is joined as it is, every
two of its chunks in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .parts import Radius, part_keys
from .shared import bitmap, in_bitmap, join_unhot, materialize
from .simhash import dealt_out, shingle_set


class Sets:
    """Sets as one flat array of element numbers, so that one marked set meets many at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        known, self.flat = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        self.mark = np.zeros(len(known) + 1, dtype=bool)

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i + 1]]

    def meet(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of intersection and union of set i with others (places; none of them empty)."""
        if not len(others):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = self.size[others]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.repeat(self.start[others] - begin, size) + np.arange(size.sum())
        self.mark[self.of(i)] = True
        shared = np.add.reduceat(self.mark[self.flat[at]], begin, dtype=np.int64)
        self.mark[self.of(i)] = False
        return shared, size + self.size[i] - shared


def walk(sets: Sets, members: np.ndarray, radius: Radius) -> Iterator[tuple[int, int]]:
    """Links that hold together what is close within members: whoever is reached leaves, and only sizes that can be close meet."""
    rest = members[np.argsort(sets.size[members], kind="stable")]
    while len(rest):
        first, todo, rest = int(rest[0]), [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            n = int(sets.size[i])
            low = np.searchsorted(sets.size[rest], -(-n * radius.percent // 100))
            high = np.searchsorted(sets.size[rest], radius.partner(n), side="right")
            near = np.flatnonzero(radius.close(*sets.meet(i, rest[low:high]))) + low
            for j in rest[near].tolist():
                todo.append(j)
                yield first, j
            rest = np.delete(rest, near)


def windows(distance: np.ndarray, close: np.ndarray, radius: Radius) -> list[np.ndarray]:
    """Members (rows) of each pivot's (column's) region that must still be compared there.

    Home is the region of the nearest pivot; a visitor's distance is at most its nearest plus twice the radius. Those
    close to the pivot are linked to it; if all are, the region is done, and if not, of them only those stay that
    somebody outside may reach.
    """
    nearest = distance.min(axis=1, keepdims=True)
    slack = 1e-9
    here = distance <= nearest + 2 * radius.distance + slack
    out = []
    for i in range(distance.shape[1]):
        outside = here[:, i] & ~close[:, i]
        if not outside.any():
            out.append(np.zeros(0, np.int64))
            continue
        reach = distance[outside, i].min() - radius.distance - slack
        out.append(np.flatnonzero(here[:, i] & (distance[:, i] >= reach)))
    return out


def region_links(sets: Sets, members: np.ndarray, radius: Radius, pivots: int = 8, few: int = 48) -> Iterator[tuple[int, int]]:
    """Links that hold together what is close within a region, by pivots of its own, again and again."""
    if len(members) <= few:
        yield from walk(sets, members, radius)
        return
    chosen = members[np.unique(np.linspace(0, len(members) - 1, pivots).astype(int))]
    distance = np.empty((len(members), len(chosen)))
    close = np.empty(distance.shape, dtype=bool)
    for c, p in enumerate(chosen.tolist()):
        shared, union = sets.meet(p, members)
        distance[:, c], close[:, c] = 1 - shared / union, radius.close(shared, union)
        for j in members[close[:, c]].tolist():
            if j != p:
                yield p, j
    inner = windows(distance, close, radius)
    if sum(map(len, inner)) > 0.8 * len(members):
        yield from walk(sets, members, radius)
        return
    for part in inner:
        yield from region_links(sets, members[part], radius, pivots, few)


def _as_sets(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype="<u8") for x in column]


def split_regions(members: DataFrame, sets: DataFrame, radius: Radius, split_above: int, pivots: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Regions of more than split_above hashes, by pivots drawn from each: links (a, b) to pivots, and members of all regions after.

    members is (label, node, n), sets (node, hashes). Pivots are the nodes that come first by as many hashes of their
    names; a region's pivots reach the tasks of its members by a join that spreads hot regions.
    """
    sizes = members.groupBy("label").agg(F.sum("n").alias("hashes"), F.count("*").alias("members"), *(F.min(F.struct(F.xxhash64("node", F.lit(level * 64 + i)), F.col("node").alias("node"))).alias(f"p{i}") for i in range(pivots)))
    sizes = materialize(sizes, "jaccard-regions")
    large = sizes.filter(F.col("hashes") > split_above)
    chosen = large.select("label", "members", F.explode(F.array_distinct(F.array(*(F.col(f"p{i}.node") for i in range(pivots))))).alias("node"))
    held = chosen.join(sets, "node").groupBy("label").agg(F.first("members").alias("members"), F.collect_list(F.struct("node", "hashes")).alias("pivots"))
    held = materialize(held, "jaccard-pivots")
    small = join_unhot(members, sizes.select("label", (F.col("hashes") <= split_above).alias("stays"), "members"), "label", "members").filter("stays").select("label", "node", "n")
    told = join_unhot(members.join(sets, "node"), held, "label", "members").select("label", "node", "n", "hashes", "pivots")

    def measured(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            out = []
            for label, node, n, mine, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), _as_sets(b.column(3)), b.column(4)):
                others = held.as_py()
                both = Sets([mine, *(np.frombuffer(x["hashes"], dtype="<u8") for x in others)])
                shared, union = both.meet(0, np.arange(1, len(others) + 1))
                distance, close = 1 - shared / union, radius.close(shared, union)
                for i, x in enumerate(others):
                    if distance[i] <= distance.min() + 2 * radius.distance + 1e-9 or close[i]:
                        region = xxhash.xxh64_intdigest(b"%d %d %d" % (label, level, x["node"])) - (1 << 63)
                        out.append((region, node, n, x["node"], float(distance[i]), bool(close[i])))
            columns = list(zip(*out)) or [()] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["label", "node", "n", "pivot", "distance", "close"])

    seen = materialize(told.mapInArrow(measured, "label long, node long, n long, pivot long, distance double, close boolean"), "jaccard-measured")
    links = seen.filter("close and node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    reach = seen.groupBy("label").agg(F.min(F.when(~F.col("close"), F.col("distance"))).alias("outside"), F.count("*").alias("members")).filter("outside is not null")
    inner = join_unhot(seen, reach, "label", "members").filter(F.col("distance") >= F.col("outside") - radius.distance - 1e-9).select("label", "node", "n")
    return links, small.unionByName(inner)


def region_joins(members: DataFrame, sets: DataFrame, radius: Radius, split_above: int = 2_000_000, levels: int = 3, pivots: int = 8) -> DataFrame:
    """Links (a, b) within each label of members (label, node, n) that hold together all close pairs; sets is (node, hashes)."""
    links, now, before = None, members, None
    for level in range(levels):
        total, large = now.groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.max("n")).first()
        if (large or 0) <= split_above or (before is not None and total > 0.8 * before):
            break  # all are small, or pivots don't make them smaller
        found, after = split_regions(now, sets, radius, split_above, pivots, level)
        links = found if links is None else links.unionByName(found)
        before, now = total, materialize(after, "jaccard-members")
    tasks = materialize(dealt_out(now, split_above), "jaccard-tasks")

    def joined(group: pa.Table) -> pa.Table:
        label, node = group.column("label").to_numpy(), group.column("node").to_numpy()
        found = Sets(_as_sets(group.column("hashes")))
        order = np.argsort(label, kind="stable")
        pairs = [p for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) for p in region_links(found, part, radius)]
        a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    rest = sets.join(tasks, "node").select("u", "i", "j", "label", "node", "hashes").groupBy("u", "i", "j").applyInArrow(joined, "a long, b long")
    return rest if links is None else links.unionByName(rest)


def _text_key(text: str | None) -> int:
    """64 bits that equal texts have in common, but for white space and A-Z in either case."""
    return xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), 99)


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, percent: int = 90, seed: int = 42, split_above: int = 2_000_000, levels: int = 3) -> DataFrame:
    """(id_col, n_shingles, component) of every document, linked by the Jaccard similarity of its set of word shingles.

    Documents link if 100 * |intersection| >= percent * |union|; component is the smallest id that chains of links
    reach, the document's own included. A text of fewer words than a shingle has the whole sequence as its one
    shingle; a null, empty or wordless text has none, is linked with nothing and is its own component. Rows that repeat
    an id give one row each; null ids never name a component, unless there is no other: then it is null. An empty
    table gives an empty one; other columns, whatever their names, are not read. Texts are read whole.
    """
    radius = Radius(percent)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def printed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            digest, size, text_key, keys = [], [], [], []
            for t in b.column(1):
                x = shingle_set(t.as_py(), shingle_words, seed)
                digest.append(xxhash.xxh128_digest(x.astype("<u8").tobytes(), seed))
                size.append(len(x)), text_key.append(_as_long(_text_key(t.as_py()))), keys.append(part_keys(x, radius).view(np.int64))
            yield pa.record_batch([b.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(text_key, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "n", "text_key", "keys"])

    # rows get a number that is written with them: nodes are named by it
    prints = materialize(rows.mapInArrow(printed, f"id {kind}, digest binary, n long, text_key long, keys array<long>").withColumn("row", F.monotonically_increasing_id()), "jaccard-prints")
    nodes = materialize(
        prints.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.first("n").alias("n"), F.min("text_key").alias("text_key"), F.count("*").alias("copies")), "jaccard-nodes"
    )
    first = nodes.select(F.col("node").alias("row"))
    filed = materialize(prints.filter("size(keys) > 0").select("row", "keys").join(first, "row", "left_semi").select(F.col("row").alias("node"), F.explode("keys").alias("k")), "jaccard-filed")
    met = materialize(filed.groupBy("k").agg(F.min("node").alias("least"), F.count("*").alias("members")).filter("members > 1"), "jaccard-met")
    near = join_unhot(filed, met, "k", "members").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    groups = materialize(components(near), "jaccard-groups")
    members = materialize(groups.join(nodes.select("node", "n", "text_key"), "node"), "jaccard-members")
    known = docs.sparkSession.sparkContext.broadcast(bitmap(members, "text_key"))

    def hashed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            texts = {_as_long(_text_key(t.as_py())): t for t in b.column(0)}
            keys = np.array(list(texts), dtype=np.int64)
            kept = keys[in_bitmap(known.value, keys)].tolist()
            sets = [shingle_set(texts[k].as_py(), shingle_words, seed).astype("<u8").tobytes() for k in kept]
            yield pa.record_batch([pa.array(kept, pa.int64()), pa.array(sets, pa.binary())], names=["text_key", "hashes"])

    # sets of candidates alone are made and shuffled, one for each text; texts are not
    made = rows.select("text").mapInArrow(hashed, "text_key long, hashes binary").dropDuplicates(["text_key"])
    sets = materialize(made.join(members.select("text_key", "node"), "text_key").select("node", "hashes"), "jaccard-sets")
    links = materialize(region_joins(members.select("label", "node", "n"), sets, radius, split_above, levels), "jaccard-links")
    placed = materialize(nodes.join(components(links), "node", "left").select("digest", F.coalesce("label", "node").alias("label"), "least", "copies"), "jaccard-placed")
    least = placed.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("members"))
    named = join_unhot(placed.drop("least"), least, "label", "members").select("digest", "component", "copies")
    told = join_unhot(prints.filter("n > 0").select("id", "digest", "n"), named, "digest", "copies").select("id", "n", "component")
    alone = prints.filter("n = 0").select("id", "n", F.col("id").alias("component"))
    return told.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component")
