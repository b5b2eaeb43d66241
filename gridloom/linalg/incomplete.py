"""Incomplete factorisations as a fixed point.

L U = A on the stored places of A, as equations in the cells of L (unit) and U: each cell is what is left of A's cell
after the products of cells before it. Row by row these are assignments; taken as equations they are also the fixed
point of a sweep that updates all cells at once from the sweep before. A sweep needs the product of L's and U's strict
parts at the stored places: cells are packed in square tiles, tiles of L and U go to the stored tiles that they multiply
into (a table of tiles, made once), and a task multiplies, adds up and updates a tile. Products are never rows of a table.
Where tiles would be sent often, as cells lie far apart, the product is a sparse one. Cells that depend on no others are exact after the first sweep, those on these after the second, and so on; for matrices with a heavy diagonal
a few sweeps are enough. Rows and columns are scaled to a unit diagonal first, which makes sweeps contract faster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matrix import SENT, COOArray, SparseMatrix
from ..operators.products import multiplied, narrow, widened
from ..plans.lineage import cut, release, small

EPS = np.finfo(float).eps
#: Rows of a tile, and how many products arrays of all its places are worth.
TILE, WORTH = 1024, 200
_STATE = "p long, q long, at binary, a binary, f binary, change double"
_NAMES = ["p", "q", "at", "a", "f", "change"]


def _tile(p: int, q: int, at: np.ndarray, a: np.ndarray, f: np.ndarray, change: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p]), pa.array([q]), *(pa.array([x], pa.binary()) for x in (_steps(at), narrow(a), narrow(f))), pa.array([float(change)])], names=_NAMES)


def _steps(at: np.ndarray) -> bytes:
    """Rising places as steps from one to the next, in few bytes."""
    return narrow(np.diff(at.astype(np.int64), prepend=0))


def _places(steps: bytes) -> np.ndarray:
    return np.cumsum(widened(steps, np.int64))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over cells (p, q, at, a) sorted by p, q: tiles whose values are the cells'."""
    held, now = [], None

    def done() -> pa.RecordBatch:
        at, a = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(at, kind="stable")
        return _tile(*now, at[order], a[order], a[order], 0.0)

    for batch in batches:
        p, q, *cells = (batch.column(n).to_numpy() for n in range(4))
        edges = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])) if len(p) else []
        for s, e in zip(edges, [*edges[1:], len(p)], strict=False):
            if (int(p[s]), int(q[s])) != now and held:
                yield done()
                held = []
            now = (int(p[s]), int(q[s]))
            held.append([x[s:e] for x in cells])
    if held:
        yield done()


def _swept(size: int):
    """Over tiles (p, q, k, side, at, a, f) sorted by p, q, k and side: the tile itself (side 0, k -1), then of each k the tile of L (side 1) and of U (side 2) that multiply into it, unless that is the tile itself, which isn't sent again; gives the tile one sweep on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = now = sums = pivot = left = None

        def done() -> pa.RecordBatch:
            p, q = now
            at, a, f = own
            if p == q:  # both sides are the tile itself
                taken(p, 1, at, f)
                taken(p, 2, at, f)
            i, j = at // size, at % size
            new = a - sums[i, j]
            if p >= q:
                low = i > j if p == q else np.ones(len(i), bool)
                new[low] /= pivot[j[low]]
            return _tile(p, q, at, a, new, abs(new - f).max(initial=0.0))

        def added(low: tuple, up: tuple) -> None:
            if len(low[0]) * len(up[0]) * WORTH < size**4:  # fewer products, about, than arrays of all places are worth
                i, j, v = multiplied(low[0], low[1], low[2], up[1], up[0], up[2])
                sums[i, j] += v
            else:
                x, y = np.zeros((size, size)), np.zeros((size, size))
                x[low[0], low[1]], y[up[0], up[1]] = low[2], up[2]
                sums[:] += x @ y

        def taken(k: int, side: int, at: np.ndarray, f: np.ndarray) -> None:
            nonlocal left
            p, q = now
            i, j = at // size, at % size
            if side == 1:
                some = i > j if k == p else slice(None)
                left = (i[some], j[some], f[some])
            else:
                if k == q:
                    on = i == j
                    pivot[i[on]] = f[on]
                some = i < j if k == q else slice(None)
                added(left, (i[some], j[some], f[some]))

        for batch in batches:
            for p, q, k, side, at, a, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, f = _places(at), widened(f, float)
                if side == 0:
                    if own is not None:
                        yield done()
                    own, now, sums, pivot = (at, widened(a, float), f), (p, q), np.zeros((size, size)), np.ones(size)
                    continue
                if k == now[0] != now[1]:  # U of this k is the tile itself
                    taken(k, 1, at, f)
                    taken(k, 2, own[0], own[2])
                elif k == now[1] != now[0]:  # L is
                    taken(k, 1, own[0], own[2])
                    taken(k, 2, at, f)
                else:
                    taken(k, side, at, f)
        if own is not None:
            yield done()

    return run


def _cells(size: int):
    """Over tiles: cells (i, j, f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, at, f in zip(*(batch.column(n).to_pylist() for n in ("p", "q", "at", "f")), strict=True):
                at, f = _places(at), widened(f, float)
                yield pa.RecordBatch.from_arrays([pa.array(p * size + at // size), pa.array(q * size + at % size), pa.array(f)], names=["i", "j", "f"])

    return run


class _Tiles:
    """The values of all cells in tiles, one sweep after the other; sent: how many cells a sweep sends to tiles."""

    def __init__(self, cells: DataFrame, n: int, size: int = TILE):
        self.size, self.spark = size, cells.sparkSession
        p, q = F.floor(F.col("i") / size), F.floor(F.col("j") / size)
        named = cells.select(p.alias("p"), q.alias("q"), ((F.col("i") - p * size) * size + F.col("j") - q * size).alias("at"), "a")
        known = cut(named.groupBy("p", "q").agg(F.count("*").alias("n")), "tiles")
        low, up = known.filter("p >= q").select("p", F.col("q").alias("k"), F.col("n").alias("x")), known.filter("p <= q").select(F.col("p").alias("k"), "q", F.col("n").alias("y"))
        met = low.join(up, "k").join(known.select("p", "q"), ["p", "q"])
        self.sent = int(met.agg(F.sum(F.col("x") + F.col("y"))).first()[0] or 0)
        self.named, self.known, self.met = named, known, met

    def start(self) -> DataFrame:
        tasks = max(self.spark.sparkContext.defaultParallelism, self.known.count())
        self.tasks = min(tasks, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.sent // TILE**2)))
        # a row for each tile and k: the tile goes as L to (p, q) for the q of its row, as U to (p, q) for the p of its column
        self.sends = cut(self.met.select("p", "q", "k").withColumn("side", F.explode(F.array(F.lit(1), F.lit(2)))).select(
            F.when(F.col("side") == 1, F.col("p")).otherwise(F.col("k")).alias("fp"), F.when(F.col("side") == 1, F.col("k")).otherwise(F.col("q")).alias("fq"), "p", "q", "k", "side").filter("fp != p OR fq != q"), "sends")
        out = cut(self.named.repartition(self.tasks, "p", "q").sortWithinPartitions("p", "q").mapInArrow(_packed, _STATE), "values")
        release(self.known)
        return out

    def sweep(self, now: DataFrame) -> DataFrame:
        own = now.select("p", "q", F.lit(-1).cast("long").alias("k"), F.lit(0).alias("side"), "at", "a", "f")
        tile = now.select(F.col("p").alias("fp"), F.col("q").alias("fq"), "at", F.lit(None).cast("binary").alias("a"), "f")
        sent = tile.join(self.sends, ["fp", "fq"]).select("p", "q", "k", "side", "at", "a", "f")
        return own.union(sent).repartition(self.tasks, "p", "q").sortWithinPartitions("p", "q", "k", "side").mapInArrow(_swept(self.size), _STATE)

    def values(self, now: DataFrame) -> DataFrame:
        return now.mapInArrow(_cells(self.size), "i long, j long, f double")

    def release(self) -> None:
        release(self.sends)


class _Products:
    """The same with cells as rows and a sparse product each sweep, for cells that lie far apart."""

    def __init__(self, cells: DataFrame, n: int):
        self.cells, self.n = cells, n
        self.below, self.above = cells.agg(F.count(F.when(F.col("i") > F.col("j"), 1)), F.count(F.when(F.col("i") < F.col("j"), 1))).first()

    def start(self) -> DataFrame:
        return cut(self.cells.select("i", "j", F.col("a").alias("f")), "values")

    def sweep(self, now: DataFrame) -> DataFrame:
        part = lambda where, stored: COOArray(now.filter(where).select("i", "j", F.col("f").alias("v")), (self.n, self.n), canonical=True, stored=stored)
        sums = part("i > j", self.below).matmat(part("i < j", self.above)).df.select("i", "j", F.col("v").alias("s"))
        pivots = small(now.filter("i = j").select("j", F.col("f").alias("d")), self.n, 16)
        met = self.cells.join(now, ["i", "j"]).join(sums, ["i", "j"], "left").join(pivots, "j")
        f = (F.col("a") - F.coalesce("s", F.lit(0.0))) / F.when(F.col("i") > F.col("j"), F.col("d")).otherwise(1.0)
        return met.select("i", "j", f.alias("new"), F.col("f").alias("old")).select("i", "j", F.col("new").alias("f"), F.abs(F.col("new") - F.col("old")).alias("change"))

    def values(self, now: DataFrame) -> DataFrame:
        return now.select("i", "j", "f")

    def release(self) -> None:
        pass


class Incomplete:
    """L (unit lower) and U of a square matrix, with cells just where it has cells; sweeps and change say how they came."""

    def __init__(self, a: SparseMatrix, *, shift: float = 0.0, tol: float = 1e-9, sweeps: int = 200):
        if a.shape[0] != a.shape[1]:
            raise ValueError(f"the matrix must be square, got {a.shape}")
        self.shape, n = a.shape, a.n_rows
        start = F.when(F.col("i") == F.col("j"), F.col("v") + float(shift)).otherwise(F.col("v"))
        named = cut(a.canonicalize().df.select("i", "j", start.alias("a")), "places")
        stored, on = named.agg(F.count("*"), F.count(F.when(F.col("i") == F.col("j"), 1))).first()
        if on < n:
            raise ValueError("each row needs a stored diagonal cell")
        diagonal = named.filter("i = j")
        if not diagonal.filter(F.abs("a") <= float(np.finfo(float).tiny)).isEmpty():
            raise RuntimeError("a diagonal cell is zero")
        roots = cut(diagonal.select(F.col("i").alias("at"), F.sqrt(F.abs("a")).alias("s")), "roots")
        scale = small(roots, n, 16)
        left, right = scale.select(F.col("at").alias("i"), F.col("s").alias("si")), scale.select(F.col("at").alias("j"), F.col("s").alias("sj"))
        cells = cut(named.join(left, "i").join(right, "j").select("i", "j", (F.col("a") / F.col("si") / F.col("sj")).alias("a")), "cells")
        release(named)
        way = _Tiles(cells, n)
        if way.sent > SENT * stored:
            release(way.known)
            way = _Products(cells, n)
        now = way.start()
        if isinstance(way, _Tiles):
            release(cells)  # tiles hold them
        for k in range(1, sweeps + 1):
            after = cut(way.sweep(now), "values")
            self.sweeps, self.change = k, float(after.agg(F.max("change")).first()[0] or 0.0)
            release(now)
            now = after
            if not np.isfinite(self.change) or self.change <= tol:
                break
        way.release()
        if not self.change <= tol:
            raise RuntimeError(f"cells still change by {self.change:.3g} after {self.sweeps} sweeps; the diagonal is too light, a shift helps")
        values = way.values(now).join(left, "i").join(right, "j")
        scaled = F.when(F.col("i") > F.col("j"), F.col("f") * F.col("si") / F.col("sj")).otherwise(F.col("f") * F.col("si") * F.col("sj"))
        self.cells = cut(values.select("i", "j", scaled.alias("v"), F.when(F.col("i") == F.col("j"), F.abs("f")).alias("pivot")), "factors")
        release(now, cells, roots)
        self.smallest, self.least = self.cells.agg(F.min("pivot"), F.min(F.when(F.col("i") == F.col("j"), F.col("v")))).first()
        if self.smallest is not None and self.smallest <= EPS:
            raise RuntimeError("a pivot is zero")
        unit = a.spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
        self.L = a._like(self.cells.filter("i > j").select("i", "j", "v").union(unit), canonical=True, dtype="float64")
        self.U = a._like(self.cells.filter("i <= j").select("i", "j", "v"), canonical=True, dtype="float64")
