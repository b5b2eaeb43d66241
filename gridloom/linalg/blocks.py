"""Triangular solves by blocks of rows.

Rows are cut into blocks of even length. A block needs the blocks in whose columns its rows have cells, which gives a
graph of blocks and each block's level in it; all blocks of a level are solved side by side, a task each, which runs
through all rows of its block, so a chain of n rows takes as many rounds as it has blocks, not n. A round sums what the
solved blocks before contribute to its rows (a join with just the levels that they need) and appends its rows as a table
of their own. Every cell is read once in a solve. The graph is the one thing on the driver: pairs of blocks, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dense import Dense, dense
from ..operators.matrix import SparseMatrix
from ..plans.lineage import cut, release, small

EPS = np.finfo(float).eps
#: Blocks that a matrix is cut into and rounds of a solve (about), rows that a block has at least, and cells that its own square may have.
BLOCKS, LEAST, MOST = 16, 1024, 4_000_000
#: Pairs of blocks that the driver looks at.
PAIRS = 4_000_000


def _substitute(unit: bool):
    """Over rows (block, i, j, v) sorted by block and i, the right-hand side having j = -1: x of each row, top down."""

    def solved(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        right = j < 0
        rows = i[right]
        x = v[right].astype(float)
        i, j, v = i[~right], j[~right], v[~right]
        first = rows[0]
        diagonal = np.ones(len(x))
        if not unit:
            diagonal[i[i == j] - first] = v[i == j]
        off = i != j
        i, j, v = i[off] - first, j[off] - first, v[off]
        edges = np.searchsorted(i, np.arange(len(x) + 1)).tolist()
        for r in range(len(x)):
            s, e = edges[r], edges[r + 1]
            if e > s:
                x[r] -= v[s:e] @ x[j[s:e]]
            x[r] /= diagonal[r]
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(x)], names=["i", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            block, *cells = (batch.column(n).to_numpy() for n in range(4))
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            for s, e in zip(edges, [*edges[1:], len(block)], strict=False):
                if block[s] != now and held:
                    yield solved(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                now = block[s]
                held.append([x[s:e] for x in cells])
        if held:
            yield solved(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


class BlockTriangular:
    """A triangular matrix, checked and cut into blocks, for many right-hand sides; written: its cells are in files, and are read there several times."""

    def __init__(self, a: SparseMatrix, *, lower: bool = True, unit_diagonal: bool = False, block: int | None = None, written: bool = False):
        if a.shape[0] != a.shape[1]:
            raise ValueError(f"the matrix must be square, got {a.shape}")
        self.spark, self.shape, self.lower, self.unit = a.spark, a.shape, lower, unit_diagonal
        n, df = a.n_rows, a.canonicalize().df
        if not lower:  # upside down, it is a lower one
            df = df.select((n - 1 - F.col("i")).alias("i"), (n - 1 - F.col("j")).alias("j"), "v")
        cells = df.select("i", "j", "v") if written else cut(df.select("i", "j", "v"), "triangle")
        # one pass: cells on the other side, cells, and diagonal cells that a division can use
        use = (F.col("i") == F.col("j")) & (F.abs("v") > float(EPS))
        above, stored, whole = cells.agg(F.count(F.when(F.col("j") > F.col("i"), 1)), F.count("*"), F.count(F.when(use, 1))).first()
        if above:
            raise ValueError("the matrix has cells on the other side of the diagonal")
        if not unit_diagonal and whole < n:
            raise RuntimeError("a row has no diagonal")
        self.block = block or self._size(cells, n, stored)
        self._cut_levels(cells, n)
        if block and self.rounds > BLOCKS and (size := self._size(cells, n, stored)) > block:
            # small blocks that need each other one after another: whole numbers of them are one block, or each would be a job
            self.block = -(-size // block) * block
            self._cut_levels(cells, n)
        of = lambda x: F.floor(F.col(x) / self.block)
        self._of = small(self.spark.createDataFrame(list(enumerate(self.level.tolist())), "p long, level long"), len(self.level))
        tagged = cells.withColumns({"p": of("i"), "q": of("j")}).join(self._of, "p")
        inside = F.col("p") == F.col("q")
        if unit_diagonal:
            tagged = tagged.filter("i != j")
        # in the order of levels, so that a round reads just its own part of the files
        self.inside = cut(tagged.filter(inside).select("level", "p", "i", "j", "v").repartitionByRange("level", "p").sortWithinPartitions("level"), "inside")
        self.across = cut(tagged.filter(~inside).select("level", "i", "j", "v").repartitionByRange("level", "i").sortWithinPartitions("level"), "across")
        release(cells)

    @staticmethod
    def _size(cells: DataFrame, n: int, stored: int) -> int:
        """Rows of a block: few blocks, none with more cells in its square than a task should hold."""
        size = max(LEAST, -(-n // BLOCKS))
        while size > LEAST:
            own = cells.filter(F.floor(F.col("i") / size) == F.floor(F.col("j") / size)).groupBy(F.floor(F.col("i") / size)).count() if stored > MOST else None
            if own is None or (own.agg(F.max("count")).first()[0] or 0) <= MOST:
                break
            size = max(LEAST, size // 2)
        return size

    def _cut_levels(self, cells: DataFrame, n: int) -> None:
        of = lambda x: F.floor(F.col(x) / self.block)
        graph = cells.select(of("i").alias("p"), of("j").alias("q")).filter("p != q").distinct()
        pairs = graph.limit(PAIRS + 1).toArrow()
        if pairs.num_rows > PAIRS:
            raise ValueError(f"more than {PAIRS} pairs of blocks need each other; take larger blocks")
        self._levels(-(-n // self.block), pairs.column(0).to_numpy(), pairs.column(1).to_numpy())

    def _levels(self, blocks: int, p: np.ndarray, q: np.ndarray) -> None:
        """level: of each block; needs: for each level, the levels of the blocks that it needs."""
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        edges = np.searchsorted(p, np.arange(blocks + 1))
        self.level = np.zeros(blocks, np.int64)
        for b in range(blocks):  # a block needs only blocks before it
            own = q[edges[b] : edges[b + 1]]
            if len(own):
                self.level[b] = self.level[own].max() + 1
        self.rounds = int(self.level.max()) + 1 if blocks else 0
        self.needs: list[set[int]] = [set() for _ in range(self.rounds)]
        for b, other in zip(self.level[p].tolist(), self.level[q].tolist(), strict=True):
            self.needs[b].add(other)

    def solve(self, b: object) -> Dense:
        b = b if isinstance(b, Dense) else dense(self.spark, np.asarray(b, float))
        n = self.shape[0]
        if b.shape != (n,):
            raise ValueError(f"expected a vector of {n}, got shape {b.shape}")
        turned = F.col("i") if self.lower else n - 1 - F.col("i")
        right = b.df.select(turned.alias("i"), "x").withColumn("p", F.floor(F.col("i") / self.block)).join(self._of, "p").select("level", "p", "i", "x")
        if self.rounds > 1:
            right = cut(right.repartitionByRange("level", "i").sortWithinPartitions("level"), "right")
        done: list[DataFrame] = []
        for t in range(self.rounds):
            own = right.filter(F.col("level") == t).select("p", "i", "x")
            if self.needs[t]:
                before = reduce(DataFrame.union, (done[k] for k in sorted(self.needs[t]))).select(F.col("i").alias("j"), "x")
                added = self.across.filter(F.col("level") == t).join(before, "j").select(F.floor(F.col("i") / self.block).alias("p"), "i", (-F.col("v") * F.col("x")).alias("x"))
                own = own.union(added).groupBy("p", "i").agg(F.sum("x").alias("x"))
            rows = own.select("p", "i", F.lit(-1).cast("long").alias("j"), F.col("x").alias("v")).union(self.inside.filter(F.col("level") == t).select("p", "i", "j", "v"))
            done.append(cut(rows.repartition("p").sortWithinPartitions("p", "i").mapInArrow(_substitute(self.unit), "i long, x double"), "solved"))
        if self.rounds > 1:
            release(right)
        if not done:
            return b
        every = reduce(DataFrame.union, done)
        return Dense(every.select(turned.alias("i"), "x"), (n,))

    def release(self) -> None:
        """Deletes the blocks; no more solves."""
        release(self.inside, self.across)
