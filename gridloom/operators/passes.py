"""Products with a few vectors that the driver holds, in one pass over a matrix that it doesn't hold.

Cells are written once as records that hold all cells of some rows or columns: a task sums their products with the
vectors, which are sent to each executor once. For A (A.T X) the task goes on, as a column's sum is all that the
column's cells are multiplied with then: A.T X is never seen outside of it. What leaves a task is its part of the result, a row
for each row that its cells touch; parts are added up by Spark in blocks of rows. No cell is ever sent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, release
from .matrix import SparseMatrix

#: Bytes of the vectors of a pass; cells of a record and of a task, about; rows of a block of sums.
PASS_BYTES, AT_ONCE, TASK_CELLS, ROWS = 64 << 20, 1 << 17, 1 << 20, 1 << 12
_KIND = "block long, at binary, x binary"


def passable(n: int, columns: int) -> bool:
    """Whether so many vectors of n values may be sent to each task."""
    return n * columns * 8 <= PASS_BYTES


def _packed(block: int, at: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["block", "at", "x"])


def _in_blocks(at: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """at is sorted."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(at // ROWS) != 0])) if len(at) else []
    for s, e in zip(first, [*first[1:], len(at)], strict=False):
        yield _packed(int(at[s]) // ROWS, at[s:e], x[s:e])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over cells (own, other, v) sorted by own: records of about AT_ONCE cells, with all cells of their indices; files may be cut anywhere but in a record."""
    held, size = [], 0

    def record(own: np.ndarray, other: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (own[first], first, other.astype(np.int32), v)], names=["own", "first", "other", "v"])

    for batch in batches:
        held.append([batch.column(n).to_numpy() for n in range(3)])
        size += batch.num_rows
        if size >= AT_ONCE:
            cells = [np.concatenate(y) for y in zip(*held, strict=True)]
            last = int(np.searchsorted(cells[0], cells[0][-1]))  # an index may go on in the next batch
            if last:
                yield record(*(y[:last] for y in cells))
            held, size = [[y[last:] for y in cells]], size - last
    if size:
        yield record(*(np.concatenate(y) for y in zip(*held, strict=True)))


def drawn(own: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Normal numbers that belong to their place and the seed."""
    place = (own[:, None] * width + np.arange(width)).astype(np.uint64)

    def uniform(salt: int) -> np.ndarray:
        x = place + np.uint64(1) + np.uint64((2 * seed + salt) * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-54

    return np.sqrt(-2 * np.log(uniform(0))) * np.cos(2 * np.pi * uniform(1))


def _products(sent, back: bool, seed: int | None = None):
    """Over records: sums of v times the vectors' rows at other, by own; or, back, these sums multiplied by the cells again and summed by other. seed: drawn numbers take the sums' place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        out = np.zeros(x.shape if back else (0, 0))
        for batch in batches:
            for record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, first, other, v = (np.frombuffer(y, kind) for y, kind in zip(record, (np.int64, np.int64, np.int32, float), strict=True))
                sums = np.add.reduceat(v[:, None] * x[other], first) if seed is None else drawn(own, x.shape[1], seed)
                if back:
                    again = v[:, None] * np.repeat(sums, np.diff([*first, len(v)]), 0)
                    rows, at = np.unique(other, return_inverse=True)
                    for c in range(x.shape[1]):
                        out[rows, c] += np.bincount(at, again[:, c], len(rows))
                else:
                    yield from _in_blocks(own, sums)
        if back:
            some = np.flatnonzero(out.any(1))
            yield from _in_blocks(some, out[some])

    return run


def _added(width: int):
    """Over parts of blocks, sorted by block: one for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, np.zeros((ROWS, width))

        def done() -> pa.RecordBatch:
            some = np.flatnonzero(out.any(1))
            return _packed(now, some + now * ROWS, out[some])

        for batch in batches:
            for block, at, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now = block
                    out[:] = 0
                out[np.frombuffer(at, np.int64) - now * ROWS] += np.frombuffer(x).reshape(-1, width)
        if now is not None:
            yield done()

    return run


class Passes:
    """A real matrix in the order of its rows, or of its columns for products with A.T first."""

    def __init__(self, a: SparseMatrix, by: str = "i"):
        self.spark, self.shape = a.spark, a.shape
        a = a if a._written else a.canonicalize().persist()
        parts = max(self.spark.sparkContext.defaultParallelism, -(-a._stored // TASK_CELLS))
        other = "j" if by == "i" else "i"
        self.n_own, self.n_other = a.shape if by == "i" else a.shape[::-1]
        ordered = a.df.select(by, other, F.col("v").cast("double")).repartitionByRange(parts, by).sortWithinPartitions(by)
        self.cells = cut(ordered.mapInArrow(_records, "own binary, first binary, other binary, v binary"), "ordered")
        self.empty = lambda: self.spark.range(self.n_own).select(F.col("id").alias("i")).join(a.df.select(F.col(by).alias("i")).distinct(), "i", "left_anti")

    def _parts(self, x: np.ndarray, back: bool, seed: int | None = None) -> tuple[DataFrame, object]:
        if x.ndim != 2 or x.shape[0] != self.n_other:
            raise ValueError(f"expected {self.n_other} rows, got shape {x.shape}")
        sent = self.spark.sparkContext.broadcast(np.ascontiguousarray(x, float))
        return self.cells.mapInArrow(_products(sent, back, seed), _KIND), sent

    def _collected(self, parts: DataFrame, sent, n: int, width: int) -> np.ndarray:
        out = np.zeros((n, width))
        for row in parts.select("at", "x").collect():
            out[np.frombuffer(row.at, np.int64)] += np.frombuffer(row.x).reshape(-1, width)
        sent.destroy()
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        """A X, or by columns A.T X."""
        parts, sent = self._parts(x, False)
        return self._collected(parts, sent, self.n_own, x.shape[1])

    def random(self, width: int, seed: int) -> np.ndarray:
        """A.T X, or by columns A X, for random X that nobody holds."""
        return self.normal(np.zeros((self.n_other, width)), seed)

    def normal(self, x: np.ndarray, seed: int | None = None) -> np.ndarray:
        """A.T (A X), or by columns A (A.T X)."""
        parts, sent = self._parts(x, True, seed)
        tasks = min(self.spark.sparkContext.defaultParallelism, -(-self.n_other // ROWS))
        return self._collected(parts.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_added(x.shape[1]), _KIND), sent, self.n_other, x.shape[1])

    def frame(self, x: np.ndarray) -> DataFrame:
        """A X, or by columns A.T X, as rows (i, k, x) that no driver holds; written, as what was sent is then deleted."""
        parts, sent = self._parts(x, False)
        width = x.shape[1]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, sums in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    at = np.frombuffer(at, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, width)), pa.array(np.tile(np.arange(width), len(at))), pa.array(np.frombuffer(sums))], names=["i", "k", "x"])

        some = parts.mapInArrow(rows, "i long, k long, x double")
        out = cut(some.union(self._zeros(width)), "product")
        sent.destroy()
        return out

    def _zeros(self, width: int) -> DataFrame:
        """Rows of places without cells."""
        return self.empty().select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("k"), F.lit(0.0).alias("x"))

    def release(self) -> None:
        release(self.cells)
