"""Cholesky and LU by fronts: each task eliminates one block of rows, and passes what is left of its rows to the next block that needs it.

Rows are cut into blocks, in their natural order. The pattern of blocks gives the elimination tree (a block's parent is
the first block that its eliminated rows and columns reach) and the fill, both before anything is computed; a front that
would be too large for a task is refused then. Blocks of one height in the tree don't need each other and are eliminated
side by side. A front holds a block's own rows and those that it reaches: cells of the matrix and the update matrices of
its children are added into it at their indices, its own rows are eliminated, their part of the factor is stored, and
the rest is its own update matrix, sent to its parent in stripes. A round is one shuffle of the cells and updates of one
height. No process holds more than its front; the driver sees pairs of blocks.

LU exchanges rows inside a block only, so P A = L U with a P of blocks; a pivot that is too small is an error."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import config
from ..operators.dense import Dense, dense
from ..operators.matrix import COOArray, SparseMatrix
from ..operators.products import narrow, widened
from ..plans.lineage import cut, release, small
from .blocks import PAIRS, BlockTriangular

EPS = np.finfo(float).eps
#: Blocks that a matrix is cut into, as few as FEW while these have no more than ROWS rows, rows that a block has at least, and values of a stripe of an update matrix.
BLOCKS, FEW, ROWS, LEAST, STRIPE = 64, 16, 512, 64, 1 << 18

#: kind: 0 cells of A (rows, cols and vals of one length), 1 an update (vals by rows and cols), 2 cells of L, 3 of U, 4 the row (cols) that stands at a place (rows), 5 a row without pivot.
_SCHEMA = "level long, p long, kind int, rows binary, cols binary, vals binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _row(level: int, p: int, kind: int, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> tuple:
    return level, p, kind, narrow(rows.astype(np.int64)), narrow(cols.astype(np.int64)), narrow(np.ascontiguousarray(vals, float).ravel())


def _batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], names=_NAMES)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (level, p, i, j, v) sorted by p, as rows of at most STRIPE cells of one front."""
    for batch in batches:
        level, p, i, j, v = (batch.column(n).to_numpy() for n in range(5))
        edges = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else []
        found = []
        for s, e in zip(edges, [*edges[1:], len(p)], strict=False):
            found += [_row(int(level[s]), int(p[s]), 0, i[at : min(e, at + STRIPE)], j[at : min(e, at + STRIPE)], v[at : min(e, at + STRIPE)]) for at in range(s, e, STRIPE)]
        if found:
            yield _batch(found)


class _Tree:
    """The elimination tree of blocks, and what a front may have at most."""

    def __init__(self, blocks: int, pairs: set[tuple[int, int]], size: int):
        reach: list[set[int]] = [set() for _ in range(blocks)]
        for p, q in pairs:
            reach[min(p, q)].add(max(p, q))
        self.parent, self.level = [-1] * blocks, [0] * blocks
        self.tiles = self.largest = 0
        for p in range(blocks):  # children come before their parents
            own = reach[p]
            own.discard(p)
            self.tiles += 1 + len(own)
            self.largest = max(self.largest, (1 + len(own)) * size)
            if own:
                up = self.parent[p] = min(own)
                reach[up] |= own
                self.level[up] = max(self.level[up], self.level[p] + 1)
            reach[p] = set()  # what a block reaches is its parent's now
        self.rounds = max(self.level, default=-1) + 1
        self._senders: list[set[int]] = [set() for _ in range(self.rounds)]
        for p, up in enumerate(self.parent):
            if up >= 0:
                self._senders[self.level[up]].add(self.level[p])

    def senders(self, level: int) -> list[int]:
        """The heights whose blocks send an update to a block of this one."""
        return sorted(self._senders[level])


def eliminated(front: np.ndarray, k: int, symmetric: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(L of the first k columns, U of the first k rows, their order, the rest, the first row without pivot or -1)."""
    order = np.arange(k)
    if symmetric:
        try:
            low = np.linalg.cholesky(front[:k, :k])
        except np.linalg.LinAlgError:
            return front[:, :k] * 0, front[:k] * 0, order, front[k:, k:] * 0, 0
        below = np.linalg.solve(low, front[k:, :k].T).T
        return np.concatenate([low, below]), np.zeros((0, 0)), order, front[k:, k:] - below @ below.T, -1
    own, right = front[:k, :k].copy(), front[:k, k:].copy()
    scale = max(abs(front).max(initial=0.0), np.finfo(float).tiny)
    for c in range(k):
        at = c + int(abs(own[c:, c]).argmax())
        if abs(own[at, c]) <= EPS * scale:
            return front[:, :k] * 0, front[:k] * 0, order, front[k:, k:] * 0, c
        if at != c:
            for x in (own, right, order):
                x[[c, at]] = x[[at, c]]
        own[c + 1 :, c] /= own[c, c]
        own[c + 1 :, c + 1 :] -= np.outer(own[c + 1 :, c], own[c, c + 1 :])
    low, up = np.tril(own, -1) + np.eye(k), np.triu(own)
    right = np.linalg.solve(low, right) if right.size else right
    below = np.linalg.solve(up.T, front[k:, :k].T).T if k < len(front) else front[k:, :k]
    return np.concatenate([low, below]), np.concatenate([up, right], axis=1), order, front[k:, k:] - below @ right, -1


def _fronts(size: int, n: int, parent: list[int], level: list[int], symmetric: bool):
    """Over rows of _SCHEMA sorted by p: each front's factor cells and its update for its parent."""

    def solved(p: int, parts: list[tuple]) -> Iterator[tuple]:
        own = np.arange(p * size, min(n, (p + 1) * size))
        parts = [(kind, widened(r, np.int64), widened(c, np.int64), widened(v, float)) for kind, r, c, v in parts]
        others = np.unique(np.concatenate([own[:0], *(x for _, r, c, _ in parts for x in (r, c))]))
        index = np.concatenate([own, others[others > own[-1]]])
        front = np.zeros((len(index), len(index)))
        while parts:
            kind, r, c, v = parts.pop()
            at = np.searchsorted(index, r), np.searchsorted(index, c)
            if kind == 0:
                front[at] += v  # each place once
            else:
                front[np.ix_(*at)] += v.reshape(len(r), len(c))
        if symmetric:
            low = np.tril(front)
            front = low + np.tril(low, -1).T
        k = len(own)
        left, up, order, rest, bad = eliminated(front, k, symmetric)
        if bad >= 0:
            yield _row(0, p, 5, own[bad : bad + 1], own[:0], own[:0])
            return
        names = np.concatenate([own[order], index[k:]])  # rows of L by their name in A
        for kind, m, rows, cols in ((2, left, names, own), (3, up, own, index)):
            i, j = np.nonzero(m)
            for at in range(0, len(i), STRIPE):
                some = slice(at, at + STRIPE)
                yield _row(0, p, kind, rows[i[some]], cols[j[some]], m[i[some], j[some]])
        if not symmetric:
            yield _row(0, p, 4, own, own[order], own[:0])
        if len(rest):
            up_to, others = parent[p], index[k:]
            height = max(1, STRIPE // len(others))
            for at in range(0, len(others), height):
                wide = at + height if symmetric else len(others)  # of a symmetric one, the lower triangle
                yield _row(level[up_to], up_to, 1, others[at : at + height], others[:wide], rest[at : at + height, :wide])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for p, *part in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if p != now and held:
                    for row in solved(now, held):
                        yield _batch([row])
                    held = []
                now = p
                held.append(tuple(part))
        if held:
            for row in solved(now, held):
                yield _batch([row])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r, c, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            i, j, v = widened(r, np.int64), widened(c, np.int64), widened(v, float)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v if len(v) else np.zeros(len(i)))], names=["i", "j", "v"])


class Frontal:
    """A factorisation by fronts: L (and U and the rows' order), and solves by blocks."""

    def __init__(self, a: SparseMatrix, *, symmetric: bool, block: int | None = None):
        if a.shape[0] != a.shape[1]:
            raise ValueError(f"the matrix must be square, got {a.shape}")
        self.spark: SparkSession = a.spark
        self.shape, n = a.shape, a.n_rows
        df = a.canonicalize().df.filter("i >= j") if symmetric else a.canonicalize().df
        least = max(LEAST, -(-n // BLOCKS))
        for size in [block] if block else sorted({least, max(least, min(ROWS, -(-n // FEW)))}, reverse=True):
            of = lambda x: F.floor(F.col(x) / size)  # noqa: B023, E731
            cells = cut(df.select("i", "j", "v", of("i").alias("bi"), of("j").alias("bj")), "cells")
            graph = cells.select("bi", "bj").distinct().limit(PAIRS + 1).toArrow()
            if graph.num_rows > PAIRS:
                raise ValueError(f"more than {PAIRS} pairs of blocks; take larger blocks")
            tree = self.tree = _Tree(-(-n // size), set(zip(graph.column(0).to_pylist(), graph.column(1).to_pylist(), strict=True)), size)
            if block or size == least or min(n, tree.largest) <= config.get("front_rows"):
                break
            release(cells)  # fewer rounds, but too large a front: smaller blocks have smaller ones
        self.block = size
        if min(n, tree.largest) > config.get("front_rows"):
            raise ValueError(f"a front may have {min(n, tree.largest)} rows, beyond the option front_rows ({config.get('front_rows')}); the factor has up to {tree.tiles} blocks of {size} x {size}")
        levels = small(self.spark.createDataFrame(list(enumerate(tree.level)), "p long, level long"), len(tree.level))
        placed = cells.select(F.least("bi", "bj").alias("p"), "i", "j", "v").join(levels, "p").select("level", "p", "i", "j", "v")
        mine = cut(placed.repartitionByRange("level", "p").sortWithinPartitions("level", "p").mapInArrow(_pack, _SCHEMA), "fronts")
        release(cells)
        run = _fronts(size, n, tree.parent, tree.level, symmetric)
        done: list[DataFrame] = []
        for t in range(tree.rounds):
            rows = reduce(DataFrame.union, [mine, *(done[k].filter("kind = 1") for k in tree.senders(t))]).filter(F.col("level") == t)
            done.append(cut(rows.repartition("p").sortWithinPartitions("p").select("p", "kind", "rows", "cols", "vals").mapInArrow(run, _SCHEMA), "factor"))
        release(mine)
        self._parts = reduce(DataFrame.union, done) if done else mine
        bad = self._parts.filter("kind = 5").select("rows").limit(1).collect()
        if bad:
            at = int(widened(bad[0].rows, np.int64)[0])
            raise RuntimeError(f"a pivot is not positive, in the block of row {at}" if symmetric else f"pivot {at} is zero: the matrix is singular, or needs rows of other blocks")
        self.L, self.U, self.perm_frame = self._cells(2), None, None
        if not symmetric:
            order = self._cells(4).df.select("i", F.col("j").alias("src"))
            self.perm_frame = cut(order, "order")
            at = small(self.perm_frame.select(F.col("i").alias("at"), "src"), n, 16)
            low = self.L.df.join(at, F.col("i") == F.col("src")).select(F.col("at").alias("i"), "j", "v")
            self.L, self.U = self._named(low), self._cells(3)
        self._solvers: tuple[BlockTriangular, BlockTriangular] | None = None

    def _named(self, df: DataFrame) -> COOArray:
        return COOArray(df, self.shape, canonical=True)

    def _cells(self, kind: int) -> COOArray:
        return self._named(self._parts.filter(F.col("kind") == kind).select("rows", "cols", "vals").mapInArrow(_unpack, "i long, j long, v double"))

    def solve(self, b: object) -> Dense:
        b = b if isinstance(b, Dense) else dense(self.spark, np.asarray(b, float))
        if b.shape != (self.shape[0],):
            raise ValueError(f"expected a vector of {self.shape[0]}, got shape {b.shape}")
        if self._solvers is None:
            self._solvers = BlockTriangular(self.L, written=True), BlockTriangular(self.L.T if self.U is None else self.U, lower=False, written=True)
        if self.perm_frame is not None:
            at = small(self.perm_frame, self.shape[0], 16)
            b = Dense(at.join(b.df.select(F.col("i").alias("src"), "x"), "src").select("i", "x"), b.shape)
        half = self._solvers[0].solve(b)
        return self._solvers[1].solve(half)

    __call__ = solve


class FrontalCholesky(Frontal):
    """A = L L.T, from the lower triangle."""

    def __init__(self, a: SparseMatrix, *, block: int | None = None):
        super().__init__(a, symmetric=True, block=block)


class FrontalLU(Frontal):
    """P A = L U; perm_frame (i, src) has the row of A that is row i of L U."""

    def __init__(self, a: SparseMatrix, *, block: int | None = None):
        super().__init__(a, symmetric=False, block=block)

    @property
    def perm(self) -> np.ndarray:
        """The order as an array, for matrices of few rows."""
        return self.perm_frame.orderBy("i").toArrow().column(1).to_numpy()
