"""Rounds of k-means on the sphere and the scores of what they find, for many models by the same rows.

A net of up to _WHOLE rows is one task's: its starts and rows come to it one after the other, sorted, and all rounds
run there, so they cost one shuffle and no job each. Rows of a larger net stay where they are, and a round is a sum
over them; its centers and sums, some numbers for each _WHOLE rows, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Rows of a net that one task takes as a whole.
_WHOLE = 1 << 16
#: Rows of small nets that one task orders, on average.
_ORDERED = 1 << 19
#: Rows that meet all centers at once.
_STEP = 2048
#: Centers (k, 3) of each model.
Models = dict[int, np.ndarray]
CENTERS = "array<struct<x: double, y: double, z: double>>"


def _met(x: np.ndarray, models: Models) -> Iterator[tuple[slice, dict[int, np.ndarray]]]:
    """Some rows at a time, and their dots to the centers of each model, by the same products and sums as in SQL."""
    every = np.concatenate(list(models.values()))
    at = np.cumsum([0] + [len(c) for c in models.values()])
    for first in range(0, len(x), _STEP):
        part = slice(first, min(first + _STEP, len(x)))
        p = x[part]
        dots = p[:, :1] * every[:, 0] + p[:, 1:2] * every[:, 1] + p[:, 2:] * every[:, 2]
        yield part, {m: dots[:, at[i] : at[i + 1]] for i, m in enumerate(models)}


def sums(x: np.ndarray, w: np.ndarray, models: Models) -> Models:
    """For each center the sum of its rows' normals times their weights, turned to its side; the first of equals has a row."""
    out = {m: np.zeros((len(c), 3)) for m, c in models.items()}
    for part, dots in _met(x, models):
        for m, d in dots.items():
            k = np.abs(d).argmax(axis=1)
            side = w[part] * np.where(d[np.arange(len(d)), k] < 0, -1.0, 1.0)
            for c in range(3):
                out[m][:, c] += np.bincount(k, weights=x[part, c] * side, minlength=d.shape[1])
    return out


def moved(models: Models, found: Models) -> Models:
    """Centers after a round. A sum that cancels out has no direction: its center stays."""
    out = {}
    for m, c in models.items():
        s = found[m]
        length = np.sqrt(s[:, 0] * s[:, 0] + s[:, 1] * s[:, 1] + s[:, 2] * s[:, 2])[:, None]
        out[m] = np.where(length > 1e-12, s / np.where(length > 1e-12, length, 1.0), c)
    return out


def same(a: Models, b: Models) -> bool:
    return all(np.array_equal(a[m], b[m]) for m in a)


def counts(x: np.ndarray, w: np.ndarray, models: Models) -> Models:
    """For each center (rows, sum of their similarities)."""
    out = {m: np.zeros((len(c), 2)) for m, c in models.items()}
    for part, dots in _met(x, models):
        for m, d in dots.items():
            near = np.abs(d)
            k = near.argmax(axis=1)
            similarity = np.minimum(1.0, near[np.arange(len(d)), k])
            out[m][:, 0] += np.bincount(k, weights=w[part], minlength=d.shape[1])
            out[m][:, 1] += np.bincount(k, weights=w[part] * similarity, minlength=d.shape[1])
    return out


def widths(x: np.ndarray, w: np.ndarray, models: Models, sets: Models) -> Models:
    """For each model the sum of the rows' silhouettes, as clusters.silhouette() has them; sets is counts() of all rows."""
    out = {m: np.zeros((1, 1)) for m in models}
    for part, dots in _met(x, models):
        for m, d in dots.items():
            near, real = np.abs(d), sets[m][:, 0] > 1
            k, row = near.argmax(axis=1), np.arange(len(d))
            a = np.where(real[k], 1 - np.minimum(1.0, near[row, k]), 0.0)
            b = np.zeros(len(d))
            if real.sum() > 1:
                other = np.where(real, near, -1.0)
                other[row, k] = -1.0
                b = 1 - np.minimum(1.0, other.max(axis=1))
            out[m] += (w[part] * ((b - a) / np.maximum(np.maximum(a, b), 1e-9))).sum()
    return out


def scores(m: int, sets: np.ndarray, width: float) -> tuple[int, float, float]:
    """(n, silhouette, bic) of a model, as clusters.silhouette() and clusters.mixture_bic()."""
    n = sets[:, 0].sum()
    rows, r = sets[sets[:, 0] > 0, 0], sets[sets[:, 0] > 0, 1] / sets[sets[:, 0] > 0, 0]
    with np.errstate(divide="ignore"):
        kappa = np.where(r > 0.999, 100.0, np.where(r < 0.01, 0.01, np.clip(r * (3 - r * r) / (1 - r * r), 0.01, 100.0)))
    kappa = np.minimum(50.0, kappa)
    log_c = np.log(kappa) - np.log(4 * 3.141592653589793) - (kappa + np.log((1 - np.exp(-2 * kappa)) / 2))
    law = (rows * (np.log(rows / n) + log_c + kappa * r)).sum()
    return round(n), width / n, -2 * law + 3 * m * np.log(n)


def _starts(models: dict[int, DataFrame]) -> DataFrame:
    """(net, m, i, x, y, z, w) of all models' centers, as rows that go before those of points."""
    each = (c.filter(F.col("net").isNotNull()).select("net", F.lit(m).alias("m"), F.posexplode("centers").alias("i", "c")).filter("c is not null") for m, c in models.items())
    return reduce(DataFrame.unionByName, each).select("net", "m", "i", *(F.col(f"c.{c}").cast("double").alias(c) for c in "xyz"), F.lit(0.0).alias("w"))


def _together(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[pa.Scalar, list[np.ndarray]]]:
    """(net, columns) of each net whose rows lie one after the other."""
    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        net = batch.column("net")
        arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        try:
            turns = pc.not_equal(net[1:], net[:-1]).to_numpy(zero_copy_only=False)
        except pa.ArrowNotImplementedError:  # structs and lists
            listed = net.to_pylist()
            turns = np.array([a != b for a, b in zip(listed[1:], listed)], dtype=bool)
        at = [0, *(np.flatnonzero(turns) + 1), batch.num_rows]
        for a, b in zip(at, at[1:]):
            if held and net[a].as_py() != name.as_py():
                yield name, [np.concatenate(c) for c in zip(*held)]
                held = []
            name = net[a]
            held.append([c[a:b] for c in arrays])
    if held:
        yield name, [np.concatenate(c) for c in zip(*held)]


def _nets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, np.ndarray, np.ndarray, Models]]:
    """(net, x, w, models) of each net that rows sorted by net, m and i bring together; a net without starts is left out."""
    for name, (m, x, y, z, w) in _together(batches, ("m", "x", "y", "z", "w")):
        v = np.stack([x, y, z], axis=1)
        models = {int(k): v[m == k] for k in np.unique(m[m >= 0])}
        if models:
            yield name, v[m < 0], w[m < 0], models


def _batch(rows: list[tuple], kinds: list[list[str]]) -> pa.RecordBatch:
    """A batch of rows (net, values) whose values are of the kinds told."""
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), CENTERS: pa.list_(pa.struct([(c, pa.float64()) for c in "xyz"]))}
    nets = pa.array([net.as_py() for net, _ in rows], type=rows[0][0].type)
    columns = zip(*(r for _, r in rows))
    return pa.RecordBatch.from_arrays([nets, *(pa.array(c, type=types[t]) for c, (_, t) in zip(columns, kinds))], names=["net", *(n for n, _ in kinds)])


def _listed(centers: np.ndarray) -> list[dict[str, float]]:
    return [dict(zip("xyz", map(float, p))) for p in centers]


def farthest_first(sorted_rows: DataFrame, k: int, pool: int) -> DataFrame:
    """(net, centers): the first of each net's rows (net, x, y, z, those of a net one after the other), then the farthest from those before, out of the first `pool`; the first of equals."""
    kinds = [["centers", CENTERS]]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for net, v in _together(batches, ("x", "y", "z")):
            x, y, z = (c[:pool] for c in v)
            at, near = [0], np.zeros(len(x))
            while len(at) < min(k, len(x)):
                c = at[-1]
                near = np.maximum(near, np.abs(x * x[c] + y * y[c] + z * z[c]))
                at.append(int(near.argmin()))
            out.append((net, (_listed(np.stack([x[at], y[at], z[at]], axis=1)),)))
            if len(out) >= 4096:
                yield _batch(out, kinds)
                out = []
        if out:
            yield _batch(out, kinds)

    return sorted_rows.mapInArrow(solve, f"net {sorted_rows.schema['net'].dataType.simpleString()}, centers {CENTERS}")


class Grid:
    """Points of every net and what is done with them and the models of each. Rows without a net, a normal or a weight count nowhere."""

    def __init__(self, rows: DataFrame, weight: str | None = None):
        spark = rows.sparkSession
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        v = [F.col(f"n{c}").cast("double").alias(c) for c in "xyz"]
        self.points = written(rows.select("net", *v, w.alias("w")).dropna(), "grid-rows")
        sizes = written(self.points.groupBy("net").agg(F.count("*").alias("n")), "grid-sizes")
        large = sizes.filter(F.col("n") > _WHOLE).select("net").collect()  # one for each _WHOLE rows at most
        self.total = sizes.filter(F.col("n") <= _WHOLE).agg(F.sum("n")).first()[0] or 0
        self.net = rows.schema["net"].dataType
        self.large = [r["net"] for r in large]
        self.few = self.points
        if large:
            schema = rows.select("net").withColumn("at", F.lit(0)).schema
            self.places = spark.createDataFrame([(net, i) for i, net in enumerate(self.large)], schema)
            self.many = written(self.points.join(self.places, "net").select("at", "x", "y", "z", "w").sortWithinPartitions("at"), "grid-large")
            # written, as is what it is put together with: two tables that are joined by net already are not dealt anew by it, and need not meet
            self.few = written(self.points.join(self.places, "net", "left_anti"), "grid-small")

    def whole(self, models: dict[int, DataFrame], do: Callable[[np.ndarray, np.ndarray, Models], list[tuple]], schema: str) -> DataFrame:
        """What do() gives, rows of a schema after net, for each net of few rows and its models."""
        starts = _starts(models)
        if self.large:
            starts = starts.join(self.places, "net", "left_anti")
        starts = written(starts, "grid-starts")
        tasks = max(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.total // _ORDERED))
        points = self.few.select("net", F.lit(-1).alias("m"), F.lit(0).alias("i"), "x", "y", "z", "w")
        met = starts.unionByName(points).repartition(tasks, "net").sortWithinPartitions("net", "m", "i", "x", "y", "z", "w")
        kinds = [c.strip().split(" ", 1) for c in schema.split(";")]

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = []
            for net, x, w, found in _nets(batches):
                out += [(net, r) for r in do(x, w, found)]
                if len(out) >= 4096:
                    yield _batch(out, kinds)
                    out = []
            if out:
                yield _batch(out, kinds)

        return met.mapInArrow(solve, ", ".join([f"net {self.net.simpleString()}", *(f"{n} {t}" for n, t in kinds)]))

    def large_models(self, models: dict[int, DataFrame]) -> list[Models]:
        """The models of every large net, by its place."""
        found: list[Models] = [{} for _ in self.large]
        if self.large:
            for r in _starts(models).join(self.places, "net").select("at", "m", "i", "x", "y", "z").orderBy("at", "m", "i").collect():
                found[r["at"]].setdefault(r["m"], []).append((r["x"], r["y"], r["z"]))
        return [{m: np.array(c) for m, c in net.items()} for net in found]

    def summed(self, models: list[Models], do: Callable[..., Models], *more: list[Models]) -> list[Models]:
        """do(x, w, models, ...) of every large net, summed over all its rows."""
        spark = self.points.sparkSession
        told = spark.sparkContext.broadcast((models, more))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, more = told.value
            held: dict[int, Models] = {}
            for batch in batches:
                at, w = batch.column("at").to_numpy(), batch.column("w").to_numpy()
                x = np.stack([batch.column(c).to_numpy() for c in "xyz"], axis=1)
                for net in (int(a) for a in np.unique(at)):
                    if models[net]:
                        own = at == net
                        got = do(x[own], w[own], models[net], *(m[net] for m in more))
                        held[net] = {m: held[net][m] + s for m, s in got.items()} if net in held else got
            rows = [(net, m, i, j, float(s)) for net, found in held.items() for m, c in found.items() for i, line in enumerate(c) for j, s in enumerate(line)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["at", "m", "i", "j", "s"])

        out: list[dict] = [{} for _ in models]
        for r in self.many.mapInArrow(part, "at int, m int, i int, j int, s double").groupBy("at", "m", "i", "j").agg(F.sum("s").alias("s")).orderBy("at", "m", "i", "j").collect():
            out[r["at"]].setdefault(r["m"], {}).setdefault(r["i"], []).append(r["s"])
        told.unpersist()
        return [{m: np.array(list(c.values())) for m, c in net.items()} for net in out]


def lloyd(rows: DataFrame, starts: dict[int, DataFrame], rounds: int, weight: str | None = None) -> dict[int, DataFrame]:
    """(net, centers) of each model after so many rounds over the rows."""
    grid, spark = Grid(rows, weight), rows.sparkSession

    def whole(x: np.ndarray, w: np.ndarray, models: Models) -> list[tuple]:
        for _ in range(rounds if len(x) else 0):
            before, models = models, moved(models, sums(x, w, models))
            if same(before, models):
                break
        return [(m, _listed(c)) for m, c in models.items()]

    found = written(grid.whole(starts, whole, f"m int; centers {CENTERS}"), "grid-centers")
    if grid.large:
        models = grid.large_models(starts)
        for _ in range(rounds):
            got = grid.summed(models, sums)
            before, models = models, [moved(m, g) if g else m for m, g in zip(models, got)]
            if all(same(a, b) for a, b in zip(before, models)):
                break
        listed = [(net, m, [tuple(map(float, p)) for p in c]) for net, own in zip(grid.large, models) for m, c in own.items()]
        found = found.unionByName(spark.createDataFrame(listed, found.schema))
    return {m: found.filter(F.col("m") == m).select("net", "centers") for m in starts}


def grid_scores(rows: DataFrame, found: dict[int, DataFrame], weight: str | None = None) -> DataFrame:
    """(net, k, n, silhouette, bic) of every model of each net that has rows."""
    grid, spark = Grid(rows, weight), rows.sparkSession

    def whole(x: np.ndarray, w: np.ndarray, models: Models) -> list[tuple]:
        if not len(x):
            return []
        sets = counts(x, w, models)
        return [(m, *scores(m, sets[m], float(s[0, 0]))) for m, s in widths(x, w, models, sets).items()]

    told = grid.whole(found, whole, "k int; n long; silhouette double; bic double")
    if grid.large:
        models = grid.large_models(found)
        sets = grid.summed(models, counts)
        got = grid.summed(models, widths, sets)
        listed = [(net, m, *map(float, scores(m, c[m], float(s[0, 0])))) for net, c, g in zip(grid.large, sets, got) for m, s in g.items()]
        told = told.unionByName(spark.createDataFrame([(net, m, int(n), s, b) for net, m, n, s, b in listed], told.schema))
    return told
