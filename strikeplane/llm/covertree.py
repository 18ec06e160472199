"""Exact top-k by inner product: dual-tree search over cover trees of queries and data.

Vectors near the same center form a cell; the centers come from a bounded sample and grow in number with the
vectors. Every query first has the k best of the sample, which bounds its kth score from below, and goes to the
cells alone that can still beat it:

    <q, p> <= <q, b> + |q| * R_b

for rows p within R_b of a center b. A cell's rows are dealt to blocks of bounded size, and its queries to groups.
Where a group and a block meet, a cover tree is built on each and both are walked together. A pair of nodes is
left out if it cannot beat the group's worst kth score:

    <q, p> <= <a, b> + |a| * R_b + R_a * |b| + R_a * R_b

for queries within R_a of a and rows within R_b of b. The k best of each block are merged for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Rounding in a radius or a bound is far below this share of it.
_SLACK = 1e-9
_LEAF = 48


class CoverTree:
    """A cover tree over the rows of an array.

    A node's point covers its rows; its children's points are rows, lie within half the node's scale of what
    they cover and more than that from each other, and the node's own point is the first of them. Small nodes
    are leaves. `radius` is the true largest distance from a node's point to its rows.
    """

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.point: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(rows):
            away = np.linalg.norm(rows - rows[0], axis=1)
            self._build(0, np.arange(len(rows)), away)
        self.norm = [float(np.linalg.norm(rows[i])) for i in self.point]

    def _build(self, point: int, members: np.ndarray, away: np.ndarray) -> int:
        node, radius = len(self.point), float(away.max())
        self.point.append(point)
        self.radius.append(radius * (1 + _SLACK))
        self.children.append([])
        self.members.append(members)
        if len(members) <= _LEAF or radius == 0:
            return node
        scale = radius / 2
        first = away <= scale
        groups = [(point, members[first], away[first])]
        rest, far = members[~first], away[~first]
        while len(rest):
            center = int(rest[np.argmax(far)])
            d = np.linalg.norm(self.rows[rest] - self.rows[center], axis=1)
            own = d <= scale
            groups.append((center, rest[own], d[own]))
            rest, far = rest[~own], far[~own]
        if len(groups) > 1 and len(groups) * 2 >= len(members):  # points far from all others: no use in a node each
            return node
        self.children[node] = [self._build(*g) for g in groups]
        return node


def dual_search(q_keys: np.ndarray, q_rows: np.ndarray, floor: np.ndarray, d_keys: np.ndarray, d_ids: np.ndarray, d_rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's key, id, score) of rows that may be among a query's k best: its k best here, of at least its floor.

    floor is a score that k rows somewhere reach for the query. The row with a query's own key never counts.
    """
    queries, data = CoverTree(q_rows), CoverTree(d_rows)
    best = np.full((len(q_keys), k), -np.inf)
    names = np.full((len(q_keys), k), np.iinfo(np.int64).max, dtype=np.int64)
    worst = floor.astype(np.float64).copy()
    if not len(q_keys) or not len(d_ids):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def compare(qm: np.ndarray, dm: np.ndarray) -> None:
        scores = q_rows[qm] @ d_rows[dm].T
        scores[q_keys[qm][:, None] == d_keys[dm][None, :]] = -np.inf
        for i in np.flatnonzero((scores.max(axis=1) >= worst[qm])).tolist():
            row = qm[i]
            good = np.flatnonzero(scores[i] >= max(worst[row], -1e300))
            if not len(good):
                continue
            s, n = np.concatenate([best[row], scores[i][good]]), np.concatenate([names[row], d_ids[dm[good]]])
            top = np.lexsort((n, -s))[:k]
            best[row], names[row] = s[top], n[top]
            worst[row] = max(worst[row], best[row, -1])

    def bound(a: int, b: int, product: float) -> float:
        ra, rb = queries.radius[a], data.radius[b]
        upper = product + queries.norm[a] * rb + ra * data.norm[b] + ra * rb
        return upper + _SLACK * (abs(upper) + 1)

    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        least = worst[queries.members[a]].min()
        if bound(a, b, float(q_rows[queries.point[a]] @ d_rows[data.point[b]])) < least:
            continue
        qc, dc = queries.children[a], data.children[b]
        if not qc and not dc:
            compare(queries.members[a], data.members[b])
        elif dc and (not qc or data.radius[b] >= queries.radius[a]):
            products = d_rows[[data.point[c] for c in dc]] @ q_rows[queries.point[a]]
            ranked = sorted(zip((bound(a, c, float(p)) for c, p in zip(dc, products)), dc))
            todo.extend((a, c) for u, c in ranked if u >= least)  # the most promising is taken next
        else:
            todo.extend((c, b) for c in qc)
    kept = np.isfinite(best)
    at = np.nonzero(kept)[0]
    return q_keys[at], names[kept], best[kept]


def usable(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, with zeros behind those that are shorter."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    size = np.array([len(x) for x in column], dtype=np.int64)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def pick_centers(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample, each farthest from those before it: the top of a cover tree."""
    if not len(sample):
        return sample
    chosen, away = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def top_k(vectors: DataFrame, k: int = 5, query: str = "true", id_col: str = "vec_id", vector_col: str = "vector", centers: int | None = None, block: int = 8192, group: int = 4096) -> DataFrame:
    """(query_id, rank int, id_col, score double): the k rows of largest inner product for each row of vectors that `query`, a condition, holds for.

    vectors has a long id_col and vector_col, arrays of doubles without nulls, whose products are exact (whole
    numbers below 2**53 in all). A shorter vector has zeros where others have more components. Ties go to
    smaller ids. A query's own row is left out, and no other: rows that repeat an id are rows of their own, as
    candidates and as queries. If there are fewer others than k, all are given. A null id takes no part. An
    empty table gives an empty one. centers (None: one for each 32768 rows, 64 to 1024) bounds what every task
    gets, with a sample of four rows for each center, 2048 at least; block and group bound what meets in one task.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.expr(query), F.lit(False)).alias("asked"), F.col(vector_col).alias("v"))
    total, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    kinds = f"query_id {vectors.schema[id_col].dataType.simpleString()}, rank int, {id_col} long, score double"
    if not total:
        return spark.createDataFrame([], kinds)
    n_centers = centers or min(1024, max(64, total // 32768))
    drawn = rows.select("id", "v").orderBy(F.xxhash64("id", "v")).limit(max(2048, 4 * n_centers)).collect()  # bounded by the centers
    sampled = np.zeros((len(drawn), width))
    for i, r in enumerate(drawn):
        sampled[i, : len(r["v"])] = r["v"]
    known = spark.sparkContext.broadcast((sampled, pick_centers(sampled, n_centers)))

    def assign(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, mid = known.value
        squares = (mid * mid).sum(axis=1)
        for b in found:
            if not b.num_rows:
                continue
            asked, v = b.column(2).to_numpy(zero_copy_only=False), _matrix(b.column(3), width)
            cell = (squares - 2 * v @ mid.T).argmin(axis=1)
            floor = np.full(len(v), -np.inf)
            mine = np.flatnonzero(asked)
            for at in range(0, len(mine), 512):
                part = mine[at : at + 512]
                if len(sample) > k:  # the query itself may be in the sample: one more than k
                    floor[part] = np.partition(v[part] @ sample.T, -k - 1, axis=1)[:, -k - 1]
            yield pa.record_batch([*b.columns, pa.array(cell.astype(np.int32)), pa.array(np.linalg.norm(v - mid[cell], axis=1)), pa.array(floor)], names=["row", "id", "asked", "v", "cell", "away", "floor"])

    placed = materialize(rows.mapInArrow(assign, "row long, id long, asked boolean, v array<double>, cell int, away double, floor double"), "vectors")
    # what is collected has at most a row for each center
    cells = sorted((r["cell"], r["n"], r["r"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect())
    radii = spark.sparkContext.broadcast((np.array([c[0] for c in cells]), np.array([c[2] for c in cells])))

    def cells_of(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (number, radius), mid = radii.value, known.value[1]
        for b in found:
            if not b.num_rows:
                continue
            v, floor = _matrix(b.column(1), width), b.column(2).to_numpy()
            upper = v @ mid[number].T + np.linalg.norm(v, axis=1)[:, None] * radius
            at, cell = np.nonzero(upper + _SLACK * (np.abs(upper) + 1) >= floor[:, None])
            yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array(number[cell].astype(np.int32))], names=["row", "d_cell"])

    asking = placed.filter("asked")
    asks = materialize(asking.select("row", "v", "floor").mapInArrow(cells_of, "row long, d_cell int"), "asks")
    n_asked = {r["d_cell"]: r["n"] for r in asks.groupBy("d_cell").agg(F.count("*").alias("n")).collect()}
    parts = [(c, -(-n_asked[c] // group), -(-n // block)) for c, n, _ in cells if c in n_asked]
    sizes = materialize(spark.createDataFrame(parts, "d_cell int, q_parts int, d_parts int"), "cell-sizes")
    # a query meets all blocks of the cells that it asks for; a block of rows is indexed once for all its queries
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    many = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    named = lambda *names: [F.col(n).alias(n) for n in names]  # noqa: E731  columns of their own on either side
    data = placed.join(sizes, F.col("cell") == F.col("d_cell")).select(*named("row", "id", "v", "d_cell"), many("q_parts").alias("q_part"), part("d_parts").alias("d_part"))
    ask = asks.join(asking.select(*named("row", "v", "floor")), "row").join(sizes, "d_cell").select(*named("row", "v", "floor", "d_cell"), part("q_parts").alias("q_part"), many("d_parts").alias("d_part"))
    keys = ["d_cell", "q_part", "d_part"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = not left.num_rows or not right.num_rows
        q, i, s = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) if empty else dual_search(
            left.column("row").to_numpy(), _matrix(left.column("v").combine_chunks(), width), left.column("floor").to_numpy(),
            right.column("row").to_numpy(), right.column("id").to_numpy(), _matrix(right.column("v").combine_chunks(), width), k,
        )
        return pa.table({"row": pa.array(q, pa.int64()), "other": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    near = ask.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(search, "row long, other long, score double")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "other")
    best = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.join(asking.select("row", F.col("id").alias("query_id")), "row").select("query_id", "rank", F.col("other").alias(id_col), "score")
