"""QR of tall matrices by a reduction tree, and what it solves.

Rows are dealt into blocks; a task folds its blocks, one at a time, into the triangular factor of all rows it has seen,
so it holds one block and one factor. Factors of tasks are then reduced FAN at a time, each round a shuffle of small
rows, until one is left: [R; block] and [R; R'] have the same triangular factor as their rows together. Right-hand sides
are more columns of the same matrix, so least squares is one pass. The orthogonal factor is never stored; it is A R^-1,
a product with the sparse matrix. What one machine holds is a factor, whose number of columns is checked
(option panel_columns); rows are without bound, and a row never has more cells than that."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import config
from ..operators.dense import Dense, dense
from ..operators.matrix import SparseMatrix
from ..plans.lineage import cut, release

EPS = np.finfo(float).eps
#: Factors that one task reduces, and values of a block of rows.
FAN, BLOCK_VALUES = 8, 1 << 18


def folded(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of the rows of r and rows, with no more rows than columns."""
    return np.linalg.qr(np.concatenate([r, rows]), mode="r") if len(rows) else r


def _packed(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])


def _blocks(width: int):
    """Over cells (block, i, j, v) sorted by block: one factor a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, now = np.zeros((0, width)), [], None

        def rows() -> np.ndarray:
            i, j, v = (np.concatenate(x) for x in zip(*held, strict=True))
            names, at = np.unique(i, return_inverse=True)  # rows without cells add nothing
            out = np.zeros((len(names), width))
            out[at, j] = v
            return out

        for batch in batches:
            block, *cells = (batch.column(n).to_numpy() for n in range(4))
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            for s, e in zip(edges, [*edges[1:], len(block)], strict=False):
                if block[s] != now and held:
                    r, held = folded(r, rows()), []
                now = block[s]
                held.append([x[s:e] for x in cells])
        if held:
            r = folded(r, rows())
        if len(r):
            yield _packed(TaskContext.get().partitionId(), r)

    return run


def _reduced(width: int):
    """Over factors (part, r) sorted by part: one for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, now = np.zeros((0, width)), None
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is not None and part != now:
                    yield _packed(now, r)
                    r = np.zeros((0, width))
                now, r = part, folded(r, np.frombuffer(data).reshape(-1, width))
        if now is not None:
            yield _packed(now, r)

    return run


def _rows(width: int) -> int:
    """Rows of a block: what a task holds is bounded by the width alone, and a fold has twice as many rows as its factor."""
    return max(1, BLOCK_VALUES // max(1, width), 2 * width)


def triangle(cells: DataFrame, width: int, fan: int = FAN, block_values: int | None = None) -> np.ndarray:
    """R of the matrix with these cells (i, j, v; each place once) and width columns; its diagonal is not negative, so it is
    the same however the rows were dealt (where the columns are independent)."""
    if width > config.get("panel_columns"):
        raise ValueError(f"{width} columns are beyond the option panel_columns ({config.get('panel_columns')})")
    per_block = _rows(width) if block_values is None else max(1, block_values // max(1, width))
    dealt = cells.select(F.floor(F.col("i") / per_block).alias("block"), "i", "j", "v").repartition("block").sortWithinPartitions("block")
    now = cut(dealt.mapInArrow(_blocks(width), "part long, r binary"), "factors")
    while (n := now.count()) > 1:
        # numbers of parts grow with the tasks, so a round's parts are even whatever tasks had rows
        low, high = now.agg(F.min("part"), F.max("part")).first()
        per = max(fan, -(-(high - low + 1) * fan // n))
        after = cut(now.select(F.floor((F.col("part") - low) / per).alias("part"), "r").repartition("part").sortWithinPartitions("part").mapInArrow(_reduced(width), "part long, r binary"), "factors")
        release(now)
        now = after
    out = np.zeros((width, width))
    for row in now.collect():  # one, of panel_columns columns at most
        own = np.frombuffer(row.r).reshape(-1, width)
        out[: len(own)] = own
    release(now)
    return np.where(np.diag(out) < 0, -1.0, 1.0)[:, None] * out


def _gram(width: int):
    """Over cells (i, j, v) sorted by i: the sum over a task's rows of each row times itself, as one row of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, tail = np.zeros((width, width)), None

        def added(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> None:
            names, at = np.unique(i, return_inverse=True)
            for s in range(0, len(names), step := max(1, BLOCK_VALUES // max(1, width))):
                some = (at >= s) & (at < s + step)
                rows = np.zeros((min(step, len(names) - s), width))
                rows[at[some] - s, j[some]] = v[some]
                out[:] += rows.T @ rows

        for batch in batches:
            cells = [batch.column(n).to_numpy() for n in range(3)]
            if tail is not None:
                cells = [np.concatenate(x) for x in zip(tail, cells, strict=True)]
            if len(cells[0]):  # the last row may go on in the next batch
                last = int(np.searchsorted(cells[0], cells[0][-1]))
                added(*(x[:last] for x in cells))
                tail = [x[last:] for x in cells]
        if tail is not None:
            added(*tail)
            yield _packed(0, out)

    return run


def _summed(width: int):
    """Over squares (part, r): their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width))
        for batch in batches:
            for data in batch.column(1).to_pylist():
                out += np.frombuffer(data).reshape(width, width)
        yield _packed(TaskContext.get().partitionId(), out)

    return run


def gram(cells: DataFrame, width: int) -> np.ndarray:
    """A.T A of the matrix with these cells (i, j, v; each place once) and few columns: rows are gathered once, and a task adds up the squares of its rows."""
    own = cut(cells.select("i", "j", "v").repartition("i").sortWithinPartitions("i").mapInArrow(_gram(width), "part long, r binary"), "squares")
    while (n := own.count()) > FAN:
        after = cut(own.repartition(-(-n // FAN)).mapInArrow(_summed(width), "part long, r binary"), "squares")
        release(own)
        own = after
    out = np.zeros((width, width))
    for row in own.toLocalIterator():  # FAN at most, of panel_columns columns at most
        out += np.frombuffer(row.r).reshape(width, width)
    release(own)
    return out


def substituted(r: np.ndarray, b: np.ndarray, transposed: bool = False) -> np.ndarray:
    """r x = b or r.T x = b for an upper triangle r."""
    x = np.array(b, float)
    n = len(r)
    for i in range(n) if transposed else range(n - 1, -1, -1):
        x[i] -= r[:i, i] @ x[:i] if transposed else r[i, i + 1 :] @ x[i + 1 :]
        x[i] /= r[i, i]
    return x


def _checked(r: np.ndarray) -> np.ndarray:
    d = abs(np.diag(r))
    if len(d) and d.min() <= EPS * max(r.shape) * d.max():
        raise RuntimeError(f"column {int(d.argmin())} depends on the columns before it")
    return r


class TallQR:
    """A = Q R for a matrix with at least as many rows as columns. R is an array, Q the product A R^-1."""

    def __init__(self, a: SparseMatrix, *, normal: bool = False):
        """normal: R from the Cholesky factor of A.T A, half the digits for one sparse product."""
        if a.shape[0] < a.shape[1]:
            raise ValueError(f"expected at least as many rows as columns, got {a.shape}")
        self.spark, self.shape, self.a = a.spark, a.shape, a.canonicalize().persist()
        if normal:
            if a.n_cols > config.get("panel_columns"):
                raise ValueError(f"{a.n_cols} columns are beyond the option panel_columns ({config.get('panel_columns')})")
            try:
                self.R = np.linalg.cholesky(gram(self.a.df, a.n_cols)).T
            except np.linalg.LinAlgError as e:
                raise RuntimeError("the columns are not independent") from e
        else:
            self.R = _checked(triangle(self.a.df, a.n_cols))

    @property
    def Q(self) -> Dense:
        return self.a.matmul(dense(self.spark, substituted(self.R, np.eye(len(self.R)))))

    def _normal(self, right: np.ndarray) -> np.ndarray:
        return substituted(self.R, substituted(self.R, right, transposed=True))

    def solve(self, b: object) -> Dense:
        """The least squares solution for a vector: by R.T R, corrected once by the residual, which makes it as good as with Q."""
        b = dense(self.spark, b)
        if b.shape != (self.shape[0],):
            raise ValueError(f"expected {self.shape[0]} rows, got shape {b.shape}")
        x = self._normal(self.a.matvec_transpose(b).collect())
        rest = b.df.select("i", "x").union(self.a.matvec(x).df.select("i", -F.col("x"))).groupBy("i").agg(F.sum("x").alias("x"))
        x += self._normal(self.a.matvec_transpose(Dense(rest, b.shape)).collect())
        return dense(self.spark, x)


class WideQR:
    """Solutions of least norm for a matrix with fewer rows than columns, from R of its transpose."""

    def __init__(self, a: SparseMatrix, *, normal: bool = False):
        self.spark, self.shape, self.a = a.spark, a.shape, a.canonicalize().persist()
        self.tall = TallQR(self.a.T, normal=normal)
        self.R = self.tall.R

    def solve(self, b: object) -> Dense:
        b = dense(self.spark, b).collect()  # a value for each row, of which a wide matrix has panel_columns at most
        if b.shape != (self.shape[0],):
            raise ValueError(f"expected {self.shape[0]} rows, got shape {b.shape}")
        y = self.tall._normal(b)
        rest = b - self.a.matvec(self.a.matvec_transpose(y)).collect()
        return self.a.matvec_transpose(y + self.tall._normal(rest))


def least_squares(a: SparseMatrix, b: Dense) -> tuple[np.ndarray, np.ndarray]:
    """(x, norms) that minimise the norms of A x - b, for a vector or some columns b, in one pass over the cells."""
    b = dense(a.spark, b)
    if b.batched or b.shape[0] != a.n_rows:
        raise ValueError(f"expected {a.n_rows} rows, got shape {b.shape}")
    n, k = a.n_cols, b.shape[1] if len(b.shape) > 1 else 1
    right = b.df.select("i", ((F.col("k") if len(b.shape) > 1 else F.lit(0)) + n).alias("j"), F.col("x").alias("v"))
    r = triangle(a.canonicalize().df.select("i", "j", "v").union(right), n + k)
    x = substituted(_checked(r[:n, :n]), r[:n, n:])
    norms = np.sqrt((r[n:, n:] ** 2).sum(0))
    return (x, norms) if len(b.shape) > 1 else (x[:, 0], norms[0])
