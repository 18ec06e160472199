"""The best partner of every set table, and what ties tables together, without the table of their pairs.

Tables are dealt to blocks of like tables. A block first finds partners and ties within itself; then every two blocks
meet with the partners known so far, and only pairs that could be better, or tie what is not tied yet, are matched.
Two bounds below the mean angle of a matching tell which: the distance of the sums of n n', for which a matching can
do no more than root 2 for each radian, by one product of matrices for all pairs of some rows; and where that lets
tables pass, the sum of each set's angle to the nearest set, in single precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grades
from .tables import written

#: Tables of a block.
_POOL_BLOCK = 4096
#: Tables from which blocks are cut out, for each block and in all.
_SAMPLE, _MOST_SAMPLE = 64, 1 << 16
#: Rows that meet a block at once.
_TILE = 32
#: Degrees by which single precision may raise a bound.
_SLACK = 0.1
#: Pairs that are matched at once.
_PAIRS = 1 << 16
_DEGREES = 180 / math.pi

Means = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _products(x: np.ndarray) -> np.ndarray:
    """n n' of axes (..., 3) as vectors of 6, whose dot products are the squares of those of the axes."""
    a, b, c = (x[..., i] for i in range(3))
    return np.stack([a * a, b * b, c * c, math.sqrt(2) * a * b, math.sqrt(2) * a * c, math.sqrt(2) * b * c], axis=-1)


class _Block:
    """Tables with what their bounds need; x is (tables, sets, 3) with zeros where a table has fewer than the others."""

    def __init__(self, x: np.ndarray, n: np.ndarray):
        self.x, self.n = x, n
        p = _products(x)
        self.sums = p.sum(axis=1)
        size = (self.sums**2).sum(axis=1, keepdims=True)
        one = np.ones_like(size)
        self.left = np.concatenate([-2 * self.sums, size, one], axis=1).astype(np.float32)
        self.right = np.ascontiguousarray(np.concatenate([self.sums, one, size], axis=1).T.astype(np.float32))
        self.sets = p.astype(np.float32)

    def ordered(self, most: int = _TILE) -> list[np.ndarray]:
        """Places of tables in tiles of like ones, by cuts at the median of the widest sum."""
        open_, done = [np.arange(len(self.x))], []
        while open_:
            at = open_.pop()
            if len(at) <= most:
                done.append(at)
                continue
            own = self.sums[at]
            by = np.argsort(own[:, np.ptp(own, axis=0).argmax()], kind="stable")
            open_ += [at[by[: len(at) // 2]], at[by[len(at) // 2 :]]]
        return [at for at in done if len(at)]


def _least(a: _Block, i: np.ndarray, b: _Block, j: np.ndarray) -> np.ndarray:
    """A bound below the mean angle of each table i of a to each table j of b: sines to the nearest set, and 90 degrees for those that b has more."""
    k = a.x.shape[1]
    rows = np.ascontiguousarray(a.sets[i].transpose(1, 0, 2)).reshape(-1, 6)
    own = b.sets[j]
    best = rows @ own[:, 0].T
    for s in range(1, own.shape[1]):
        np.maximum(best, rows @ own[:, s].T, out=best)
    np.subtract(1, best, out=best)
    np.maximum(best, 0, out=best)
    np.sqrt(best, out=best)
    total = best.reshape(k, len(i), len(j)).sum(axis=0)
    total -= (k - a.n[i]).astype(np.float32)[:, None]  # a set that is none has a sine of 1
    total *= np.float32(_DEGREES)
    m, n = a.n[i][:, None], b.n[j][None, :]
    total += 90 * np.maximum(0, n - m).astype(np.float32)
    total /= np.maximum(m, n).astype(np.float32)
    return total


def _exact(means: Means, a: _Block, i: np.ndarray, b: _Block, j: np.ndarray) -> np.ndarray:
    parts = [means(a.x[i[f : f + _PAIRS]], b.x[j[f : f + _PAIRS]], a.n[i[f : f + _PAIRS]], b.n[j[f : f + _PAIRS]]) for f in range(0, len(i), _PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


class _Partners:
    """The best partner so far of each table of a block: its angle and name, the first of equals."""

    def __init__(self, angle: np.ndarray):
        self.angle, self.name, self.told = angle.copy(), [None] * len(angle), np.zeros(len(angle), dtype=bool)

    def take(self, at: np.ndarray, angle: np.ndarray, names: np.ndarray, most: float) -> None:
        ok = (angle < most) & (angle <= self.angle[at])
        for t, m, o in zip(at[ok].tolist(), angle[ok].tolist(), names[ok].tolist()):
            if m < self.angle[t] or (m == self.angle[t] and (self.name[t] is None or o < self.name[t])):
                self.angle[t], self.name[t], self.told[t] = m, o, True


def _roots(n: int) -> tuple[np.ndarray, Callable[[int], int]]:
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    return root, top


def within(means: Means, block: _Block, names: np.ndarray, copies: np.ndarray, most: float, tied: float) -> tuple[_Partners, np.ndarray]:
    """The partners of tables of a block in it, and the place of the first table that chains of ties lead to. copies says how many tables a row stands for."""
    n = len(names)
    found, every = _Partners(np.full(n, np.inf)), np.arange(n)
    own = np.flatnonzero(copies > 1)
    found.take(own, _exact(means, block, own, block, own), names[own], most)
    for i in block.ordered() if n > 1 else []:
        least = _least(block, i, block, every)
        least[np.arange(len(i)), i] = np.inf
        near = least.argmin(axis=1)
        found.take(i, _exact(means, block, i, block, near), names[near], most)
        r, c = np.nonzero(least <= np.minimum(found.angle[i], most)[:, None] + _SLACK)
        again = c != near[r]
        r, c = i[r[again]], c[again]
        found.take(r, _exact(means, block, r, block, c), names[c], most)
    first, rest = np.full(n, -1), every
    while len(rest):
        first[rest[0]], ahead, rest = rest[0], [rest[0]], rest[1:]
        while ahead and len(rest):
            at = np.array([ahead.pop()])
            maybe = np.flatnonzero(_least(block, at, block, rest)[0] < tied + _SLACK)
            hit = maybe[_exact(means, block, np.repeat(at, len(maybe)), block, rest[maybe]) < tied]
            first[rest[hit]] = first[at[0]]
            ahead += rest[hit].tolist()
            rest = np.delete(rest, hit)
    return found, first


def between(means: Means, a: _Block, b: _Block, names: tuple[np.ndarray, np.ndarray], angle: tuple[np.ndarray, np.ndarray], first: tuple[np.ndarray, np.ndarray], most: float, tied: float) -> tuple[_Partners, _Partners, list[tuple[int, int]]]:
    """Better partners of tables of a in b and the other way round, and pairs (place in a, in b) that tie what `first` (a number for each table) has apart."""
    partners = _Partners(angle[0]), _Partners(angle[1])
    (tops_a, at_a), (tops_b, at_b) = (np.unique(f, return_index=True) for f in first)
    group_a, group_b = np.searchsorted(tops_a, first[0]), np.searchsorted(tops_b, first[1]) + len(tops_a)
    root, top = _roots(len(tops_a) + len(tops_b))
    ties = []

    def tie(i: np.ndarray, j: np.ndarray) -> None:
        for p, q in zip(i.tolist(), j.tolist()):
            u, w = top(group_a[p]), top(group_b[q])
            if u != w:
                root[max(u, w)] = min(u, w)
                ties.append((p, q))

    if len(tops_a) * len(tops_b) <= _POOL_BLOCK:  # one table of each, which most often is enough
        i, j = (g.ravel() for g in np.meshgrid(at_a, at_b, indexing="ij"))
        hit = _exact(means, a, i, b, j) < tied
        tie(i[hit], j[hit])
    k = max(a.x.shape[1], b.x.shape[1])
    reach = lambda degrees: np.square(math.sqrt(2) * k * (degrees + _SLACK) / _DEGREES, dtype=np.float32) + np.float32(1e-5 * k * k)
    cap = lambda angle: np.minimum(angle, most).astype(np.float32)
    whole = len({top(i) for i in range(len(root))}) == 1
    for i in a.ordered():
        own, other = cap(partners[0].angle[i]), cap(partners[1].angle)
        limit = np.maximum(own[:, None], other[None, :])
        if not whole:
            tops = np.array([top(g) for g in range(len(root))])
            apart = tops[group_a[i]][:, None] != tops[group_b][None, :]
            limit = np.where(apart, np.maximum(limit, np.float32(tied)), limit)
        passed = a.left[i] @ b.right <= reach(limit)
        j = np.flatnonzero(passed.any(axis=0))
        if not len(j):
            continue
        r, c = np.nonzero(passed[:, j] & (_least(a, i, b, j) <= limit[:, j] + _SLACK))
        r, c = i[r], j[c]
        for f in range(0, len(r), _PAIRS):
            p, q = r[f : f + _PAIRS], c[f : f + _PAIRS]
            got = _exact(means, a, p, b, q)
            partners[0].take(p, got, names[1][q], most)
            partners[1].take(q, got, names[0][p], most)
            if not whole:
                hit = got < tied
                tie(p[hit], q[hit])
        if not whole:
            whole = len({top(g) for g in range(len(root))}) == 1
    return *partners, ties


def _read(table: pa.Table, k: int) -> tuple[np.ndarray, _Block]:
    names = np.array(table.column("t").to_pylist(), dtype=object)
    x = np.stack([table.column(f"x{i}").to_numpy() for i in range(3 * k)], axis=1).reshape(-1, k, 3)
    n = table.column("n").to_numpy()
    return names, _Block(x, n)


def _cuts(sample: np.ndarray, leaves: int) -> list:
    """A tree of cuts that deals rows to about so many leaves: [column, value, below, above] or the number of a leaf."""
    count = iter(range(1 << 30))

    def grown(rows: np.ndarray, leaves: int) -> list | int:
        wide = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        if leaves < 2 or len(rows) < 2 or not wide.max() > 0:
            return next(count)
        c = int(wide.argmax())
        value = float(np.median(rows[:, c]))
        low = rows[:, c] < value
        if not low.any():
            value = float(rows[rows[:, c] > value, c].min())
            low = rows[:, c] < value
        return [c, value, grown(rows[low], leaves // 2), grown(rows[~low], leaves - leaves // 2)]

    return grown(sample, leaves)


def _leaf(tree: list | int, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree, dtype=np.int32)
    c, value, below, above = tree
    low, out = x[:, c] < value, np.empty(len(x), dtype=np.int32)
    out[low], out[~low] = _leaf(below, x[low]), _leaf(above, x[~low])
    return out


def _flat(tables: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """(t, n, copies, x0, x1, ..) of tables that differ, (t, o) of those that equal the table o, and how many sets a table has at most."""
    axes = F.array_sort(F.collect_list(F.struct("set_id", "mx", "my", "mz")))
    sets = tables.groupBy(F.col(name).alias("t")).agg(axes.alias("s")).select("t", F.flatten(F.transform("s", lambda s: F.array(*(s[f"m{c}"].cast("double") for c in "xyz")))).alias("s"))
    sets = written(sets, "table-sets")
    k = (sets.agg(F.max(F.size("s"))).first()[0] or 0) // 3
    flat = [F.coalesce(F.get("s", F.lit(i)), F.lit(0.0)).alias(f"x{i}") for i in range(3 * k)]
    apart = written(sets.groupBy("s").agg(F.min("t").alias("t"), F.count("*").alias("copies")).select("t", (F.size("s") / 3).cast("int").alias("n"), "copies", "s", *flat), "table-axes")
    same = apart.filter("copies > 1").select("s", F.col("t").alias("o"))
    return apart.drop("s"), sets.join(same, "s").filter("t <> o").select("t", "o"), k


def partners_and_ties(tables: DataFrame, name: str, means: Means, most: float, tied: float = grades.GREEN) -> tuple[DataFrame, DataFrame]:
    """(t, o, mean_angle): each table's best partner, where one lies below `most`; and pairs (a, b) below `tied` that tie together all that such pairs do.

    Of partners below `tied` of one angle any may stand there; of others it is the first.
    """
    flat, copies, k = _flat(tables, name)
    spark, kind = tables.sparkSession, tables.schema[name].dataType.simpleString()
    if not k:
        none = tables.select(F.col(name).alias("t"), F.col(name).alias("o"), F.lit(0.0).alias("mean_angle")).limit(0)
        return none, none.select(F.col("t").alias("a"), F.col("o").alias("b"))
    total = flat.count()
    leaves = -(-total // _POOL_BLOCK)
    tree: list | int = 0
    columns = [f"x{i}" for i in range(3 * k)]

    def sums(x: np.ndarray) -> np.ndarray:
        return _products(x.reshape(-1, k, 3)).sum(axis=1)

    if leaves > 1:
        size = min(leaves * _SAMPLE, _MOST_SAMPLE)  # it only says which tables meet first
        few = flat.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.lit(float(1 << 20)) * min(1.0, size / total)).select(*columns).limit(2 * size).toArrow()
        tree = _cuts(sums(np.stack([few.column(c).to_numpy() for c in columns], axis=1)), min(leaves, size // 2))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
            yield batch.append_column("leaf", pa.array(_leaf(tree, sums(x))))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)
    placed = written(flat.mapInArrow(dealt, kinds + ", leaf int"), "pool-leaves")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("m")).collect()  # about one for each _POOL_BLOCK tables
    before, at = {}, 0
    for r in sorted(sizes):
        before[r["leaf"]] = (at, -(-r["m"] // _POOL_BLOCK))  # a leaf of too many tables is several blocks
        at += before[r["leaf"]][1]
    blocks = max(at, 1)
    starts = spark.createDataFrame([(leaf, start, parts) for leaf, (start, parts) in before.items()] or [(0, 0, 1)], "leaf int, start int, parts int")
    placed = placed.join(starts, "leaf").withColumn("block", (F.col("start") + F.pmod(F.xxhash64("t"), F.col("parts"))).cast("int")).drop("leaf", "start", "parts")

    def alone(table: pa.Table) -> pa.Table:
        names, block = _read(table, k)
        found, first = within(means, block, names, table.column("copies").to_numpy(), most, tied)
        kind = table.column("t").type
        out = {"angle": pa.array(found.angle), "o": pa.array(found.name, type=kind), "first": pa.array(names[first].tolist(), type=kind)}
        for c, values in out.items():
            table = table.append_column(c, values)
        return table

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    told = written(placed.groupBy("block").applyInArrow(alone, f"{kinds}, angle double, o {kind}, first {kind}"), "pool-blocks")
    best = told.filter("o is not null").select("t", "o", F.col("angle").alias("mean_angle"))
    ties = told.select(F.col("t").alias("a"), F.col("first").alias("b")).filter("a <> b")
    if blocks > 1:
        own = [F.col(c).alias(c) for c in ("t", "n", "angle", "first", *columns)]  # columns of their own on either side
        left = told.filter(F.col("block") < blocks - 1).select(F.col("block").alias("block_a"), F.explode(F.sequence(F.col("block") + 1, F.lit(blocks - 1))).alias("block_b"), *own)
        right = told.filter(F.col("block") > 0).select(F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block_a"), F.col("block").alias("block_b"), *own)

        def met(x: pa.Table, y: pa.Table) -> pa.Table:
            kind = (x if x.num_rows else y).column("t").type
            out: list[tuple] = []
            if x.num_rows and y.num_rows:
                (p, a), (q, b) = _read(x, k), _read(y, k)
                first = [np.unique(np.array(t.column("first").to_pylist()), return_inverse=True)[1] for t in (x, y)]
                *found, pairs = between(means, a, b, (p, q), tuple(t.column("angle").to_numpy() for t in (x, y)), tuple(first), most, tied)
                for names, f in zip((p, q), found):
                    out += [(names[i], f.name[i], float(f.angle[i])) for i in np.flatnonzero(f.told)]
                out += [(p[i], q[j], -1.0) for i, j in pairs]
            t, o, angle = zip(*out) if out else ((), (), ())
            return pa.table({"t": pa.array(t, type=kind), "o": pa.array(o, type=kind), "mean_angle": pa.array(angle, type=pa.float64())})

        keys = ("block_a", "block_b")
        more = written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, f"t {kind}, o {kind}, mean_angle double"), "pool-pairs")
        best = best.unionByName(more.filter("mean_angle >= 0"))
        ties = ties.unionByName(more.filter("mean_angle < 0").select(F.col("t").alias("a"), F.col("o").alias("b")))
    best = written(best.groupBy("t").agg(F.min(F.struct("mean_angle", "o")).alias("b")).select("t", "b.o", "b.mean_angle"), "pool-best")
    copied = copies.join(best.select(F.col("t").alias("o"), "mean_angle"), "o").select("t", "o", "mean_angle")
    return best.unionByName(copied), ties.unionByName(copies.select(F.col("t").alias("a"), F.col("o").alias("b")))
