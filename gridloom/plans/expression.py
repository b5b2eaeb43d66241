"""Lazy matrix expressions: rewrites that need shapes, which Catalyst doesn't know.

lazy(A) @ lazy(B) @ x is evaluated from the right, so (A.T @ A) @ x never forms the product of matrices; a chain of
sparse products is ordered by dynamic programming over sketches of its parts (plans.sizes); transposes move to the leaves."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dense import Dense
from ..operators.matrix import SparseMatrix
from ..operators.products import PRODUCTS
from . import sizes
from .lineage import cut


@dataclass(frozen=True)
class Lazy:
    """A product of matrices, kept as its factors."""

    factors: tuple[SparseMatrix, ...]

    @property
    def shape(self) -> tuple[int, int]:
        return self.factors[0].n_rows, self.factors[-1].n_cols

    @property
    def T(self) -> Lazy:
        return Lazy(tuple(f.T for f in reversed(self.factors)))

    @property
    def H(self) -> Lazy:
        return Lazy(tuple(f.H for f in reversed(self.factors)))

    def __matmul__(self, other: object) -> Lazy | Dense:
        if isinstance(other, SparseMatrix):
            other = Lazy((other,))
        if isinstance(other, Lazy):
            if self.shape[1] != other.shape[0]:
                raise ValueError(f"dimension mismatch: {self.shape} @ {other.shape}")
            return Lazy(self.factors + other.factors)
        for f in reversed(self.factors):
            other = f @ other
        return other

    def order(self) -> tuple:
        """The cheapest bracketing, as nested pairs of factor numbers.

        Products of parts of the chain are counted by contracted index: cells of each column of the left part times cells
        of each row of the right one, exact for single factors and from sketches for products. Chains so small that any
        order is cheap are ordered by their shapes."""
        f = self.factors
        n = len(f)
        if n <= 2:
            return tuple(range(n)) if n == 2 else 0
        full = {(a, k, b): float(f[a].n_rows) * f[k].n_cols * f[b].n_cols for a, k, b in self._splits()}
        return self._cheapest(full if max(full.values()) <= PRODUCTS else self._counted())

    def _splits(self) -> list[tuple[int, int, int]]:
        """(a, k, b): factors a to k times factors k + 1 to b."""
        n = len(self.factors)
        return [(a, k, b) for a in range(n) for b in range(a + 1, n) for k in range(a, b)]

    def _cheapest(self, made: dict[tuple[int, int, int], float]) -> tuple:
        @lru_cache(None)
        def best(a: int, b: int) -> tuple[float, object]:
            """(products, bracketing) of factors a to b."""
            return (0.0, a) if a == b else min(((best(a, k)[0] + best(k + 1, b)[0] + made[a, k, b], (best(a, k)[1], best(k + 1, b)[1])) for k in range(a, b)), key=lambda x: x[0])

        return best(0, len(self.factors) - 1)[1]

    def _counted(self) -> dict[tuple[int, int, int], float]:
        f, n = self.factors, len(self.factors)
        written = {id(x): x if x._written else x.canonicalize().persist() for x in f}
        cells = [written[id(x)].df.select("i", "j") for x in f]
        rows, cols = {}, {}  # (first, last) of a part: its rows' cells, its columns' cells
        for last in range(n):
            sketch = sizes.sketched(cells[last])
            rows[last, last] = cells[last].groupBy("i").agg(F.count("*").cast("double").alias("n"))
            for first in range(last - 1, 0, -1):
                rows[first, last] = cut(sizes.row_cells(sketch := sizes.through(cells[first], sketch)), "rows")
        turned = [x.select(F.col("j").alias("i"), F.col("i").alias("j")) for x in cells]
        for first in range(n - 1):
            sketch = sizes.sketched(turned[first])
            cols[first, first] = turned[first].groupBy("i").agg(F.count("*").cast("double").alias("n"))
            for last in range(first + 1, n - 1):
                cols[first, last] = cut(sizes.row_cells(sketch := sizes.through(turned[last], sketch)), "columns")
        splits = self._splits()
        counts = [cols[a, k].join(rows[k + 1, b].withColumnRenamed("n", "m"), "i").agg(F.lit(t).alias("t"), F.sum(F.col("n") * F.col("m")).alias("p")) for t, (a, k, b) in enumerate(splits)]
        return {splits[t]: p or 0.0 for t, p in reduce(DataFrame.union, counts).collect()}

    def evaluate(self) -> SparseMatrix:
        def run(x: object) -> SparseMatrix:
            return self.factors[x] if isinstance(x, int) else run(x[0]).matmat(run(x[1]))

        return run(self.order())


def lazy(a: SparseMatrix) -> Lazy:
    return Lazy((a,))
