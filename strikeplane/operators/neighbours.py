"""Spatial joins by a grid: exact nearest neighbours, neighbours within a radius, overlapping discs.

Points are filed under the cell of a grid that they lie in and meet those of the 27 cells around them through an
equi-join. Spark shuffles cells, so no two points far apart are ever compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import with_quantiles
from .tables import written

#: A cell should hold about this many times k points.
_FILL = 2.0
#: A cell with more than this many times k + 1 places is dense, and its net takes narrower cells.
_DENSE = 32
#: Cells a net may have along an axis, from zero to its farthest place: doubles tell no more apart.
_MOST_CELLS = 2.0**50
#: Rows of one part of a net, where a query meets all of it.
_PART = 65536
#: Cells are as wide as for this many neighbours at least: a group of rows costs a task more than some distances.
_LEAST_FILL = 16
#: Queries of one cell that meet its data in one task, and pairs of them that a task looks at at once.
_ASKED, _AT_ONCE = 8192, 1 << 18
#: Discs of one part of a cell, which one task keeps, and of one block of it.
_DISCS, _BLOCK = 4096, 64

_PLACE = ("px", "py", "pz")


def squared(a: str, b: str) -> Column:
    return sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in ("px", "py", "pz")), F.lit(0.0))


def _cell(side: Column, c: str) -> Column:
    return F.floor(F.col(c) / side).cast("long")


def _around(points: DataFrame) -> DataFrame:
    """Each point once for its own cell and the 26 next to it, in columns gx, gy, gz."""
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    for c, g in (("cx", "gx"), ("cy", "gy"), ("cz", "gz")):
        points = points.withColumn("__d", F.explode(near)).withColumn(g, F.col(c) + F.col("__d")).drop("__d")
    return points


def _placed(points: DataFrame) -> DataFrame:
    return points.select("net", "id", "px", "py", "pz").dropna()


def _cells(points: DataFrame, side: Column) -> DataFrame:
    return points.withColumns({g: _cell(side, c) for c, g in (("px", "cx"), ("py", "cy"), ("pz", "cz"))})


def _sides(places: DataFrame, k: int) -> DataFrame:
    """(net, __side, __span, __parts): a side of cells for each net at which no cell holds many times k places.

    It starts at one that holds a few times k where places lie evenly. While a cell of a net holds more than `_DENSE`
    times k + 1, the net's side goes down to a third, and only places of such cells are counted again; so an outlier,
    which makes the span wide, or a dense spot costs some counts and not a cell with most of the rows.
    """
    span = places.groupBy("net").agg(
        F.count("*").alias("__n"),
        F.greatest(*(F.max(c) - F.min(c) for c in ("px", "py", "pz")), F.lit(1e-9)).alias("__span"),
        F.greatest(*(F.max(F.abs(F.col(c))) for c in ("px", "py", "pz"))).alias("__far"),
    )
    side = F.col("__span") * F.pow(F.least(F.lit(1.0), F.lit(_FILL * k) / F.col("__n")), F.lit(1 / 3))
    sides = written(span.select("net", side.alias("__side"), "__span", (F.col("__far") / _MOST_CELLS).alias("__least"), F.ceil(F.col("__n") / _PART).cast("int").alias("__parts")), "near-sides")
    dense = places.drop("id")
    while True:
        open_sides = sides.filter(F.col("__side") / 3 > F.col("__least")).select("net", "__side")
        counted = _cells(dense.join(open_sides, "net"), F.col("__side")).drop("__side")
        heavy = written(counted.groupBy("net", "cx", "cy", "cz").agg(F.count("*").alias("n")).filter(F.col("n") > _DENSE * (k + 1)), "near-dense").drop("n")
        if heavy.isEmpty():
            return sides.drop("__least")
        dense = written(counted.join(heavy, ["net", "cx", "cy", "cz"], "left_semi").select("net", "px", "py", "pz"), "near-dense")
        narrow = heavy.select("net").distinct().withColumn("__narrow", F.lit(True))
        sides = written(sides.join(narrow, "net", "left").withColumn("__side", F.when(F.col("__narrow"), F.col("__side") / 3).otherwise(F.col("__side"))).drop("__narrow"), "near-sides")


def _k_nearest(k: int, own: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What gives the k nearest of some data for each of some queries, as (net, id, other, d2), ties to the smaller id."""

    def search(asked: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(data):
            return pd.DataFrame({"net": asked["net"].iloc[:0], "id": asked["id"].iloc[:0], "other": data["id"].iloc[:0], "d2": np.zeros(0)})
        data = data.sort_values("id", kind="stable")
        ids, places = data["id"].to_numpy(), [data[c].to_numpy() for c in ("px", "py", "pz")]
        row, at, far = [], [], []
        step = max(1, _AT_ONCE // len(data))
        for first in range(0, len(asked), step):
            some = asked.iloc[first : first + step]
            d2 = np.zeros((len(some), len(data)))
            for c, p in zip(("px", "py", "pz"), places):
                off = some[c].to_numpy()[:, None] - p
                off *= off
                d2 += off
            d2[np.isnan(d2)] = np.inf
            free = np.ones(d2.shape, dtype=bool) if own else np.asarray(some["id"].to_numpy()[:, None] != ids)
            d2[~free] = np.inf
            # all rows as near as the kth, of which equals are told apart by id: data are in its order
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1 : k] if k < len(data) else np.full((len(some), 1), np.inf)
            i, j = np.nonzero((d2 <= kth) & free)
            found = d2[i, j]
            order = np.lexsort((j, found, i))
            i, j, found = i[order], j[order], found[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            row.append(i[kept] + first)
            at.append(j[kept])
            far.append(found[kept])
        i, j = np.concatenate(row), np.concatenate(at)
        return pd.DataFrame({"net": asked["net"].to_numpy()[i], "id": asked["id"].to_numpy()[i], "other": ids[j], "d2": np.concatenate(far)})

    return search


def nearest(queries: DataFrame, data: DataFrame, k: int, own: bool = False) -> DataFrame:
    """(net, id, rank, other, d2): each query's k nearest rows of data in its net, ties to the smaller id.

    queries and data have net, id, px, py, pz. own says whether a row with the query's id counts. A query meets the
    rows in its cell and the 26 around it in one task, which keeps the k nearest, so no row is made for a pair; it is done when its kth neighbour is closer than the cells reach, and else
    tries cells of three times the side, in the end all of its net in parts of `_PART` rows. So results are exact.
    Of rows at one place only the k + 1 of smallest id can be among the nearest, so copies don't meet each other
    all. Rows with a null net, id or place take no part; a query whose net has no data has no neighbours.
    """
    same = Window.partitionBy("net", "px", "py", "pz").orderBy("id")
    places = written(_placed(data).withColumn("__c", F.row_number().over(same)).filter(F.col("__c") <= k + 1).drop("__c"), "near-places")
    kinds, other = ({f.name: f.dataType.simpleString() for f in x.schema} for x in (queries, data))
    other = other["id"]
    sides = _sides(places, max(k, _LEAST_FILL))
    left = _placed(queries).join(sides.select("net"), "net", "left_semi")
    cell = ["net", "gx", "gy", "gz", "part"]
    w = Window.partitionBy("net", "id").orderBy("d2", "other")
    done: DataFrame | None = None
    for i in count():
        s = F.col("__side") * (3.0**i)
        whole = s >= F.col("__span")  # one cell for each net, in parts
        parts = F.when(whole, F.col("__parts")).otherwise(F.lit(1))
        filed = lambda df: df.join(sides, "net").withColumns({g: F.when(whole, F.lit(0).cast("long")).otherwise(_cell(s, c)) for c, g in (("px", "gx"), ("py", "gy"), ("pz", "gz"))} | {"__all": parts, "__whole": whole})  # noqa: E731,B023
        q = filed(left).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__all") - 1))).select("net", "id", "px", "py", "pz", "gx", "gy", "gz", "part")
        # data go to the cells around them, queries to their own: a query's rows are met in one task, and pairs stay there
        d = filed(places).withColumn("part", F.pmod(F.xxhash64("id"), F.col("__all")).cast("int")).withColumnsRenamed({"gx": "cx", "gy": "cy", "gz": "cz"})
        d = _around(d).filter(~F.col("__whole") | ((F.col("gx") == 0) & (F.col("gy") == 0) & (F.col("gz") == 0))).select("net", "id", "px", "py", "pz", "gx", "gy", "gz", "part")
        # queries of a full cell are dealt to several tasks, each with the cell's data
        asked = written(q.groupBy(*cell).agg(F.ceil(F.count("*") / _ASKED).cast("int").alias("__deals")), "near-asked")
        q = q.join(asked, cell).withColumn("__deal", F.pmod(F.xxhash64("id"), F.col("__deals")).cast("int")).drop("__deals")
        d = d.join(asked, cell).withColumn("__deal", F.explode(F.sequence(F.lit(0), F.col("__deals") - 1))).drop("__deals")
        keys = [*cell, "__deal"]
        met = q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(_k_nearest(k, own), f"net {kinds['net']}, id {kinds['id']}, other {other}, d2 double")
        ranked = written(met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "near-ranked")
        # sure: k found within the distance that the cells around a point cover, or all of the net seen
        found = ranked.groupBy("net", "id").agg(F.count("*").alias("__got"), F.max("d2").alias("__far")).join(sides, "net")
        sure = found.filter(whole | ((F.col("__got") >= k) & (F.col("__far") <= s * s))).select("net", "id")
        told = ranked.join(sure, ["net", "id"], "left_semi").select("net", "id", "rank", "other", "d2")
        done = told if done is None else done.unionByName(told)
        open_nets = sides.filter(~whole).select("net")
        left = written(left.join(sure, ["net", "id"], "left_anti").join(open_nets, "net", "left_semi"), "near-left")
        if left.isEmpty():
            return done
    raise AssertionError


def within(queries: DataFrame, data: DataFrame, radius: float, own: bool = False) -> DataFrame:
    """(net, id, other, d2): rows of data within radius of a query in its net."""
    s = F.lit(float(radius))
    cells = lambda df: df.select("net", "id", "px", "py", "pz", *(_cell(s, c).alias(g) for c, g in (("px", "cx"), ("py", "cy"), ("pz", "cz"))))
    q = _around(cells(queries)).drop("cx", "cy", "cz")
    d = cells(data).withColumnsRenamed({"cx": "gx", "cy": "gy", "cz": "gz"})
    met = q.alias("q").join(d.alias("d"), ["net", "gx", "gy", "gz"]).select("net", F.col("q.id").alias("id"), F.col("d.id").alias("other"), squared("q", "d").alias("d2"))
    met = met.filter(F.col("d2") <= radius * radius)
    return met if own else met.filter("id <> other")


def _disc_cells(discs: DataFrame, side: float, box: tuple[float, float, float] | None) -> tuple[DataFrame, DataFrame]:
    """discs with their cell gx, gy, gz, and with each cell that holds their partners: their own (side 1), and those behind it, in the order of cells, within their radius and half a side (side 2)."""
    counts = [None] * 3
    if box is not None:
        counts = [max(1, int(b // side)) for b in box]
        discs = discs.withColumns({w: F.pmod(F.col(p), F.lit(b)) for p, w, b in zip(_PLACE, ("wx", "wy", "wz"), box)})
        wide = [F.lit(b / n) for b, n in zip(box, counts)]
        cells = {c: F.least(F.floor(F.col(w) / h), F.lit(n - 1)).cast("long") for w, h, n, c in zip(("wx", "wy", "wz"), wide, counts, ("cx", "cy", "cz"))}
    else:
        discs = discs.withColumns({w: F.col(p) for p, w in zip(_PLACE, ("wx", "wy", "wz"))})
        wide = [F.lit(side)] * 3
        cells = {c: F.floor(F.col(w) / side).cast("long") for w, c in zip(("wx", "wy", "wz"), ("cx", "cy", "cz"))}
    own = visits = discs.withColumns(cells)
    for c, g, e, w, h, n in zip(("cx", "cy", "cz"), ("gx", "gy", "gz"), ("ex", "ey", "ez"), ("wx", "wy", "wz"), wide, counts):
        low, high = F.col(w) - F.col(c) * h, (F.col(c) + 1) * h - F.col(w)  # how far it is to the cells before and behind
        step = lambda d, off: F.struct(F.lit(d).cast("long").alias("d"), F.greatest(off, F.lit(0.0)).alias("off"))
        steps = [step(0, F.lit(0.0))]
        if n is None or n > 2:
            steps += [step(-1, low), step(1, high)]
        elif n == 2:  # the other cell lies on both sides
            steps += [step(1, F.least(low, high))]
        visits = visits.withColumn("__s", F.explode(F.array(*steps))).withColumn(e, F.col("__s.off"))
        at = F.col(c) + F.col("__s.d")
        visits = visits.withColumn(g, at if n is None else F.pmod(at, F.lit(n))).drop("__s")
    here, there = F.struct("cx", "cy", "cz"), F.struct(F.col("gx").alias("cx"), F.col("gy").alias("cy"), F.col("gz").alias("cz"))
    rounding = 1e-14 * F.greatest(*(F.abs(F.col(p)) for p in _PLACE), F.lit(side))
    reach = F.abs("radius") + side / 2 + rounding
    visits = visits.filter((there >= here) & (F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez") <= reach * reach * (1 + 1e-9)))
    rows = ("net", "gx", "gy", "gz", "id", *_PLACE, "radius")
    return own.withColumnsRenamed({"cx": "gx", "cy": "gy", "cz": "gz"}).select(*rows), visits.withColumn("side", F.when(there == here, 1).otherwise(2)).select(*rows, "side")


class _Discs:
    """Discs of a part of a cell, in blocks of those that lie close together, and those that visitors overlap."""

    def __init__(self, places: np.ndarray, radius: np.ndarray, box: tuple[float, float, float] | None) -> None:
        self.box = box
        wrapped = places if box is None else places % np.array(box)[:, None]
        low, high = wrapped.min(1), wrapped.max(1)
        fine = max(1, int(np.ceil((len(radius) / _BLOCK) ** (1 / 3))))
        at = np.minimum((wrapped - low[:, None]) * (fine / np.maximum(high - low, 1e-300))[:, None], fine - 1).astype(np.int64)
        code = (at[0] * fine + at[1]) * fine + at[2]
        order = self.order = np.argsort(code, kind="stable")
        self.places, self.radius = places[:, order], radius[order]
        edges = np.flatnonzero(np.diff(code[order], prepend=-1))
        self.starts = np.concatenate([np.arange(a, b, 4 * _BLOCK) for a, b in zip(edges, np.append(edges[1:], len(order)))])
        self.ends = np.append(self.starts[1:], len(order))
        wrapped = wrapped[:, order]
        least, most = (f.reduceat(wrapped, self.starts, axis=1) for f in (np.minimum, np.maximum))
        self.middle, self.half = (least + most) / 2, (most - least) / 2
        self.widest = np.maximum.reduceat(np.abs(self.radius), self.starts) + 1e-14 * np.abs(places).max()
        self.room = np.empty((3, 1 << 14))

    def overlaps(self, places: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which visitors overlap which discs of the part, by their numbers as they were given."""
        gap = np.zeros((len(self.starts), len(radius)))
        for c in range(3):
            x = places[c] if self.box is None else places[c] % self.box[c]
            off = np.abs(x - self.middle[c][:, None])
            if self.box is not None:
                off = np.minimum(off, self.box[c] - off)
            gap += np.square(np.maximum(off - self.half[c][:, None], 0.0))
        near = gap <= np.square(np.abs(radius) * (1 + 1e-9) + self.widest[:, None] * (1 + 1e-9))
        for block in np.flatnonzero(near.any(1)):
            own, visitors = slice(self.starts[block], self.ends[block]), np.flatnonzero(near[block])
            m = own.stop - own.start
            some = max(1, self.room.shape[1] // m)
            for first in range(0, len(visitors), some):
                v = visitors[first : first + some]
                x, y, d2 = (r[: m * len(v)].reshape(m, len(v)) for r in self.room)  # kept arrays: new ones of this size cost more than the sums
                for c in range(3):
                    p, q = places[c][v], self.places[c][own]
                    np.subtract(p, q[:, None], out=x)
                    np.abs(x, out=x)
                    if self.box is not None and 2 * max(p.max() - q.min(), q.max() - p.min()) > self.box[c]:
                        np.subtract(self.box[c], x, out=y)
                        np.minimum(x, y, out=x)
                    np.multiply(x, x, out=x if c else d2)
                    if c:
                        d2 += x
                np.add(radius[v], self.radius[own][:, None], out=x)
                x *= x
                at = np.flatnonzero(d2 < x)
                j = at // len(v)
                if len(at):
                    yield v[at - j * len(v)], self.order[own][j]


def _overlaps(box: tuple[float, float, float] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows in the order of parts, a part's own discs before its visitors, the pairs of both; a task keeps one part, visitors pass by."""

    def told(net: pa.Scalar, pairs: list) -> pa.RecordBatch:
        a, b = (pa.concat_arrays(x) for x in zip(*((a, b) for a, b, _ in pairs)))
        return pa.RecordBatch.from_arrays([pa.repeat(net, len(a)), a, b, pa.array(np.concatenate([np.full(len(a), s, np.int32) for a, _, s in pairs]))], names=["net", "a", "b", "side"])

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, discs, last_net, pairs, n = None, [], None, None, [], 0
        for batch in found:
            if not batch.num_rows:
                continue
            net, ids = batch.column("net"), batch.column("id")
            gx, gy, gz, part, side = (batch.column(c).to_numpy() for c in ("gx", "gy", "gz", "part", "side"))
            places, radius = np.array([batch.column(c).to_numpy() for c in _PLACE]), batch.column("radius").to_numpy()
            new = pc.not_equal(net.slice(1), net.slice(0, len(net) - 1)).to_numpy(zero_copy_only=False)
            for x in (gx, gy, gz, part, side):
                new = new | (x[1:] != x[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1), len(net)]
            for first, last in zip(cuts, cuts[1:]):
                here = (net[first].as_py(), gx[first], gy[first], gz[first], part[first])
                rows = slice(first, last)
                if here != key:
                    key, held, discs = here, [], None
                if side[first] == 0:
                    held.append((ids.slice(first, last - first), places[:, rows], radius[rows]))
                    continue
                if discs is None:
                    if not held:
                        continue
                    own, *found_in = zip(*held)
                    own, discs, held = pa.concat_arrays(own), _Discs(*(np.concatenate(x, axis=-1) for x in found_in), box), []
                for i, j in discs.overlaps(places[:, rows], radius[rows]):
                    if pairs and (n >= 1 << 16 or net[first] != last_net):
                        yield told(last_net, pairs)
                        pairs, n = [], 0
                    last_net, n = net[first], n + len(i)
                    pairs.append((ids.take(pa.array(i + first)), own.take(pa.array(j)), side[first]))
        if pairs:
            yield told(last_net, pairs)

    return read


def disc_edges(discs: DataFrame, largest: float, box: tuple[float, float, float] | None = None) -> DataFrame:
    """(net, a, b), a < b: discs whose centers are closer than the sum of their radii.

    discs has net, id, px, py, pz, radius, none above largest; cells have twice that side. With a box, space is
    periodic: distances are those to the nearest image, and cells go round it. A disc meets those of its own cell and
    of the cells in reach behind it, so no pair is looked at twice; a crowded cell is many parts. Both sides are
    shuffled by cells and sorted: compressed files of discs look small, but their rows as one broadcast table would
    lie whole in the driver. A part keeps its discs in blocks, and those that pass by are compared with the blocks
    they can reach, so work is little more than the pairs found.
    """
    own, visits = _disc_cells(discs.select("net", "id", *_PLACE, "radius").dropna(), 2.0 * largest, box)
    cell = ["net", "gx", "gy", "gz"]
    parts = own.groupBy(*cell).agg(F.ceil(F.count("*") / _DISCS).cast("int").alias("parts"))
    own = own.hint("merge").join(parts, cell).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("side", F.lit(0))
    visits = visits.hint("merge").join(parts, cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = int(discs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.drop("parts").unionByName(visits.drop("parts")).repartition(tasks, *cell, "part").sortWithinPartitions(*cell, "part", "side")
    kinds = {f.name: f.dataType.simpleString() for f in discs.schema}
    met = dealt.mapInArrow(_overlaps(box), f"net {kinds['net']}, a {kinds['id']}, b {kinds['id']}, side int")
    # a disc of the same cell is a visitor too, so those pairs come from both sides
    return met.filter((F.col("a") < F.col("b")) | ((F.col("side") == 2) & (F.col("a") > F.col("b")))).select("net", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def knn_scale(rows: DataFrame, k: int = 8) -> DataFrame:
    """(net, n, scale): the median, over a net's rows, of the distance to the kth nearest other; the farthest where there are fewer."""
    far = nearest(rows, rows, k).groupBy("net", "id").agg(F.sqrt(F.max("d2")).alias("far"))
    return with_quantiles(far.groupBy("net").agg(F.count("*").alias("n")), far, ["net"], "far", {"scale": 0.5})


def local_planes(rows: DataFrame, k: int = 16) -> DataFrame:
    """(net, id, l1, l2, l3, e1x .. e3z): spread of each row's k nearest places, its own included; e3 is the local plane's normal."""
    from .aggregates import eigen

    near = nearest(rows, rows, k, own=True).select("net", "id", "other")
    places = rows.select("net", F.col("id").alias("other"), "px", "py", "pz")
    met = near.join(places, ["net", "other"])
    p = {c: F.col(f"p{c}") for c in "xyz"}
    # places of one neighbourhood are near each other, but may be far from zero: from the row's own place
    own = rows.select("net", "id", *(F.col(f"p{c}").alias(f"o{c}") for c in "xyz"))
    d = {c: p[c] - F.col(f"o{c}") for c in "xyz"}
    moments = met.join(own, ["net", "id"]).groupBy("net", "id").agg(*((F.avg(d[a] * d[b]) - F.avg(d[a]) * F.avg(d[b])).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))
    return eigen(moments, ["net", "id"])
