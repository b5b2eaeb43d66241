"""How large products of sparse matrices are, before they are made.

A sketch of a row is the least of exponential random numbers that belong to the columns where it has cells, for each of
KEYS numbers a column. The row of A B has cells where rows of B have that A's row points to, so its sketch is the least
of their sketches: a product's sketch costs a pass over A's cells, whatever the product's size, and with n cells in a row
the sum of its KEYS numbers is about KEYS / n. Chains of products are sketched from the right, a factor at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Random numbers of a column; the error of a row's estimate is about one in the root of their number.
KEYS = 128
_NAMES = [f"s{t}" for t in range(KEYS)]


@dataclass(frozen=True)
class Facts:
    """Stored cells of A and B, products of A B, the most cells of a row of A and of a column of B, the result's rows and columns, and the most cells of both at a contracted index."""

    a: int
    b: int
    products: int
    longest_row: int
    longest_col: int
    rows: int
    cols: int
    longest_inner: int = 0


def facts(a: DataFrame, b: DataFrame, rows: int, cols: int) -> Facts:
    """Counts by index on both sides, in one job; a and b are cells (i, j, v)."""

    def count(df: DataFrame, key: str, kind: int) -> DataFrame:
        return df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).select("k", *(F.when(F.lit(kind == t), F.col("n")).otherwise(0).alias(f"n{t}") for t in range(4)))

    none = F.lit(0).cast("long")
    inner = count(a, "j", 0).union(count(b, "i", 1)).groupBy("k").agg(F.sum("n0").alias("x"), F.sum("n1").alias("y"))
    inner = inner.select("x", "y", (F.col("x") * F.col("y")).alias("p"), none.alias("r"), none.alias("c"))
    outer = count(a, "i", 2).union(count(b, "j", 3)).select(none, none, none, "n2", "n3")
    n = inner.union(outer).agg(F.sum("x"), F.sum("y"), F.sum("p"), F.max("r"), F.max("c"), F.max(F.col("x") + F.col("y"))).first()
    *n, inner = (int(x or 0) for x in n)
    return Facts(*n, rows, cols, inner)


def _exponential(key: Column, t: int) -> Column:
    """An exponential random number that belongs to the key."""
    return -F.log((F.shiftrightunsigned(F.xxhash64(F.lit(t), key), 11).cast("double") + 1) / float(2**53)).cast("double")


def sketched(cells: DataFrame) -> DataFrame:
    """(i, s0, s1, ...): the sketch of each row that has cells."""
    return cells.groupBy("i").agg(*(F.min(_exponential(F.col("j"), t)).cast("float").alias(s) for t, s in enumerate(_NAMES)))


def through(cells: DataFrame, sketch: DataFrame) -> DataFrame:
    """The sketch of A B from A's cells and the sketch of B."""
    return cells.select(F.col("i").alias("row"), "j").join(sketch.withColumnRenamed("i", "j"), "j").groupBy(F.col("row").alias("i")).agg(*(F.min(s).alias(s) for s in _NAMES))


def row_cells(sketch: DataFrame) -> DataFrame:
    """(i, n): about how many cells each row has."""
    total = sum((F.col(s).cast("double") for s in _NAMES[1:]), F.col(_NAMES[0]).cast("double"))
    return sketch.select("i", ((KEYS - 1) / total).alias("n"))


def product_cells(*factors: DataFrame) -> float:
    """About how many cells the product of matrices with these cells (i, j) has."""
    sketch = sketched(factors[-1])
    for cells in reversed(factors[:-1]):
        sketch = through(cells, sketch)
    return float(row_cells(sketch).agg(F.sum("n")).first()[0] or 0.0)
