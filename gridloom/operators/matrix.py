"""Sparse matrices as relations.

A matrix is a frame of cells (i, j, v) and what the driver knows of it: shape, value type, layout, and whether
cells are free of duplicates. Duplicate cells add up wherever cells are read. The layout (COO, CSR, CSC) says in
which order cells are exported and which kind of matrix results have; no operator needs the cells in that order.
"""

from __future__ import annotations

from numbers import Number

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans import sizes
from ..plans.lineage import BROADCAST_BYTES, cleaned, cut, release, small
from . import products
from .dense import Dense, dense

#: Cells of a dense result that todense makes at most, unless told otherwise.
DENSE_CELLS = 50_000_000
#: Columns of a dense operand (of all batches) that travel side by side.
WIDE = 64
#: Products of one contracted index that one task makes.
TASK_PRODUCTS = 10_000_000
#: How many times, on average, a product may send each cell before the result's size is estimated.
SENT = 6
#: Rows of one block when counts become running sums.
BLOCK = 1 << 16


def cells(df: DataFrame, i: str = "i", j: str = "j", v: str = "v", dtype: str = "float64") -> DataFrame:
    return df.select(F.col(f"`{i}`").cast("long").alias("i"), F.col(f"`{j}`").cast("long").alias("j"), F.col(f"`{v}`").cast(V.sql_type(dtype)).alias("v"))


class SparseMatrix:
    layout = "coo"

    def __init__(self, df: DataFrame, shape: tuple[int, int], *, dtype: str = "float64", canonical: bool = False, stored: int | None = None):
        if len(shape) != 2 or any(isinstance(n, bool) or int(n) != n or n < 0 for n in shape):
            raise ValueError(f"shape must be two non-negative integers, got {shape!r}")
        if dtype not in (*V.REAL, V.COMPLEX):
            raise TypeError(f"unknown value type {dtype!r}")
        self.df, self.shape, self.dtype, self.canonical, self._stored = df, (int(shape[0]), int(shape[1])), dtype, canonical, stored
        self._turned: DataFrame | None = None  # the cells of which these are the transpose

    # --- metadata
    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def n_rows(self) -> int:
        return self.shape[0]

    @property
    def n_cols(self) -> int:
        return self.shape[1]

    @property
    def nnz(self) -> int:
        """Stored cells: explicit zeros and duplicates count. An action, remembered."""
        if self._stored is None:
            self._stored = self.df.count()
        return self._stored

    @property
    def has_canonical_format(self) -> bool:
        return self.canonical

    def __repr__(self) -> str:
        return f"{type(self).__name__}(shape={self.shape}, dtype={self.dtype}, canonical={self.canonical})"

    def _like(self, df: DataFrame, shape: tuple[int, int] | None = None, *, canonical: bool | None = None, stored: int | None = None, layout: str | None = None, dtype: str | None = None) -> SparseMatrix:
        out = LAYOUTS[layout or self.layout](df, shape or self.shape, dtype=dtype or self.dtype, canonical=self.canonical if canonical is None else canonical, stored=stored)
        if df is self.df:
            out._turned = self._turned
        return out

    def validate(self) -> SparseMatrix:
        """Raises if a cell is outside the shape or null; one aggregate."""
        bad = self.df.filter(F.col("i").isNull() | F.col("j").isNull() | F.col("v").isNull() | (F.col("i") < 0) | (F.col("i") >= self.n_rows) | (F.col("j") < 0) | (F.col("j") >= self.n_cols))
        if not bad.isEmpty():
            raise ValueError(f"a cell is null or outside the shape {self.shape}")
        return self

    def persist(self) -> SparseMatrix:
        """Written once to the shared folder, for matrices that many plans read."""
        df = cut(self.df)
        return self._like(df, stored=df.count() if self._stored is None else self._stored)  # the files say how many

    def view(self, name: str) -> SparseMatrix:
        self.df.createOrReplaceTempView(name)
        return self

    # --- layouts
    def tocoo(self, *, canonical: bool | None = None) -> COOArray:
        a = self.canonicalize() if canonical else self
        return a._like(a.df, canonical=a.canonical if canonical is None else bool(canonical), stored=a._stored, layout="coo")

    def tocsr(self, *, canonical: bool | None = None) -> CSRArray:
        a = self.canonicalize() if canonical else self
        return a._like(a.df, stored=a._stored, layout="csr")

    def tocsc(self, *, canonical: bool | None = None) -> CSCArray:
        a = self.canonicalize() if canonical else self
        return a._like(a.df, stored=a._stored, layout="csc")

    def asformat(self, layout: str | None) -> SparseMatrix:
        check_format(layout)
        if layout in (None, self.layout):
            return self
        return {"coo": self.tocoo, "csr": self.tocsr, "csc": self.tocsc}[layout]()

    def sum_duplicates(self) -> SparseMatrix:
        """One cell per place; explicit zeros stay."""
        return self._like(self.df.groupBy("i", "j").agg(V.total(self.dtype, F.col("v")).alias("v")), canonical=True)

    def canonicalize(self) -> SparseMatrix:
        return self if self.canonical else self.sum_duplicates()

    def prune(self) -> SparseMatrix:
        """Without cells that are exactly zero."""
        return self._like(self.df.filter(V.nonzero(self.dtype, F.col("v"))))

    def _axes(self) -> tuple[str, str, int]:
        return ("j", "i", self.n_cols) if self.layout == "csc" else ("i", "j", self.n_rows)

    def sort_indices(self) -> SparseMatrix:
        """Cells of a row (a column for CSC) in one partition, in order."""
        a, b, _ = self._axes()
        return self._like(self.df.repartition(a).sortWithinPartitions(a, b), stored=self._stored)

    def packed(self) -> DataFrame:
        """A row per compressed row or column: its cells in order, as an array of structs."""
        a, b, _ = self._axes()
        return self.df.groupBy(a).agg(F.array_sort(F.collect_list(F.struct(b, "v"))).alias("cells"))

    def indptr(self) -> DataFrame:
        """(place, start, stop) of each compressed row or column, empty ones too.

        Counts are summed in blocks of rows and the blocks' sums run on, so no window spans the whole matrix."""
        a, _, n = self._axes()
        count = self.df.select(F.col(a).alias("place"), F.lit(1).alias("c")).union(self.spark.range(n).select("id", F.lit(0))).groupBy("place").agg(F.sum("c").alias("c"))
        block = F.floor(F.col("place") / BLOCK)
        within = count.withColumn("block", block).withColumn("s", F.sum("c").over(W.partitionBy("block").orderBy("place")))
        sums = count.groupBy(block.alias("block")).agg(F.sum("c").alias("t")).withColumn("before", F.sum("t").over(W.orderBy("block")) - F.col("t"))
        out = within.join(small(sums.select("block", "before"), n // BLOCK + 1), "block")
        return out.select("place", (F.col("before") + F.col("s") - F.col("c")).alias("start"), (F.col("before") + F.col("s")).alias("stop"))

    # --- projections and filters
    def _scaled(self, a: object) -> SparseMatrix:
        if isinstance(a, bool) or not isinstance(a, Number):
            return NotImplemented
        if isinstance(a, complex) and self.dtype != V.COMPLEX:
            raise TypeError("a real matrix can't be scaled by a complex number")
        return self._like(self.df.withColumn("v", V.mul(self.dtype, F.col("v"), V.lit(self.dtype, a))), stored=self._stored)

    def __mul__(self, other: object) -> SparseMatrix:
        return self._scaled(other)

    def __rmul__(self, other: object) -> SparseMatrix:
        return self._scaled(other)

    def __neg__(self) -> SparseMatrix:
        return self._scaled(-1.0)

    def astype(self, dtype: str) -> SparseMatrix:
        return self._like(self.df.withColumn("v", V.cast(F.col("v"), self.dtype, dtype)), dtype=dtype, stored=self._stored)

    def conj(self) -> SparseMatrix:
        return self if self.dtype != V.COMPLEX else self._like(self.df.withColumn("v", V.conj(self.dtype, F.col("v"))), stored=self._stored)

    conjugate = conj

    def transpose(self) -> SparseMatrix:
        """A projection; the transpose of CSC cells read by columns is CSR, otherwise the layout stays."""
        out = self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        turned = self._like(out, (self.n_cols, self.n_rows), stored=self._stored, layout="csr" if self.layout == "csc" else self.layout)
        turned._turned = self.df
        return turned

    @property
    def T(self) -> SparseMatrix:
        return self.transpose()

    @property
    def H(self) -> SparseMatrix:
        return self.conj().transpose()

    def tril(self, k: int = 0) -> SparseMatrix:
        return self._like(self.df.filter(F.col("j") - F.col("i") <= k))

    def triu(self, k: int = 0) -> SparseMatrix:
        return self._like(self.df.filter(F.col("j") - F.col("i") >= k))

    # --- aggregates
    def _filled(self, rows: DataFrame, keys: list[str], frame: DataFrame | None, n: tuple[int, ...], batched: bool = False) -> Dense:
        """Sums of rows (keys, x) with a zero at each place of frame: zeros are added, so one shuffle does both."""
        zero = frame.select(*keys, V.lit(self.dtype, 0).alias("x"))
        return Dense(rows.select(*keys, "x").union(zero).groupBy(*keys).agg(V.total(self.dtype, F.col("x")).alias("x")), n, self.dtype, batched)

    def _places(self, n: int) -> DataFrame:
        return self.spark.range(n).select(F.col("id").alias("i"))

    def row_sums(self) -> Dense:
        return self._filled(self.df.select("i", F.col("v").alias("x")), ["i"], self._places(self.n_rows), (self.n_rows,))

    def col_sums(self) -> Dense:
        return self._filled(self.df.select(F.col("j").alias("i"), F.col("v").alias("x")), ["i"], self._places(self.n_cols), (self.n_cols,))

    column_sums = col_sums

    def _norms(self, axis: str, n: int) -> Dense:
        square = self.canonicalize().df.select(F.col(axis).alias("i"), V.square(self.dtype, F.col("v")).alias("x"))
        zero = self._places(n).select("i", F.lit(0.0).alias("x"))
        return Dense(square.union(zero).groupBy("i").agg(F.sqrt(F.sum("x")).alias("x")), (n,))

    def row_norms(self) -> Dense:
        return self._norms("i", self.n_rows)

    def col_norms(self) -> Dense:
        return self._norms("j", self.n_cols)

    column_norms = col_norms

    def diagonal(self) -> Dense:
        n = min(self.shape)
        return self._filled(self.df.filter("i = j").select("i", F.col("v").alias("x")), ["i"], self._places(n), (n,))

    def trace(self) -> DataFrame:
        return self.df.filter("i = j").agg(V.total(self.dtype, F.col("v")).alias("x"))

    def sum(self, axis: int | None = None) -> Dense | DataFrame:
        if axis is None:
            return self.df.agg(V.total(self.dtype, F.col("v")).alias("x"))
        if axis in (1, -1):
            return self.row_sums()
        if axis in (0, -2):
            return self.col_sums()
        raise ValueError(f"axis must be None, 0, 1, -1 or -2, got {axis!r}")

    def dot(self, other: SparseMatrix) -> DataFrame:
        """The sum of products at equal places, without conjugation."""
        return self._inner(other, conjugate=False)

    def vdot(self, other: SparseMatrix) -> DataFrame:
        """The same with this matrix conjugated."""
        return self._inner(other, conjugate=True)

    def _inner(self, other: SparseMatrix, conjugate: bool) -> DataFrame:
        if not isinstance(other, SparseMatrix):
            raise TypeError(f"expected a sparse matrix, got {type(other).__name__}")
        if self.shape != other.shape:
            raise ValueError(f"shapes differ: {self.shape} and {other.shape}")
        kind = V.promoted(self.dtype, other.dtype)
        a = self.canonicalize().df.select("i", "j", V.cast(F.col("v"), self.dtype, kind).alias("a"))
        b = other.canonicalize().df.select("i", "j", V.cast(F.col("v"), other.dtype, kind).alias("b"))
        left = V.conj(kind, F.col("a")) if conjugate else F.col("a")
        return a.join(b, ["i", "j"]).agg(V.total(kind, V.mul(kind, left, F.col("b"))).alias("x"))

    def todense(self, most: int = DENSE_CELLS) -> Dense:
        """Every cell as a row (i, k, x); more than most of them are refused, as zeros would be most of the result."""
        if self.n_rows * self.n_cols > most:
            raise ValueError(f"a dense {self.shape} matrix has more than {most} cells")
        rows = self.df.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
        grid = self.spark.range(self.n_rows * self.n_cols).select(F.floor(F.col("id") / max(1, self.n_cols)).alias("i"), (F.col("id") % max(1, self.n_cols)).alias("k"))
        return self._filled(rows, ["i", "k"], grid, self.shape)

    # --- products
    def _operand(self, x: object, n: int, batched: bool | None = None) -> Dense:
        x = dense(self.spark, x, batched, V.COMPLEX if self.dtype == V.COMPLEX else None)
        at = 1 if x.batched else 0
        if x.shape[at] != n:
            raise ValueError(f"dimension mismatch: the matrix has {n} where the operand has {x.shape[at]}")
        if (x.dtype == V.COMPLEX) != (self.dtype == V.COMPLEX):
            raise TypeError("values of matrix and operand must have one type")
        return x

    def _times(self, x: Dense, on: str, to: str, n: int) -> Dense:
        """The sum over on of cells times x, a row for each place of to."""
        extra = [c for c in x.keys if c != "i"]
        if extra and self.dtype != V.COMPLEX and 0 < _rows(x) <= WIDE * x.shape[1 if x.batched else 0]:
            return self._times_wide(x, on, to, n)
        side = small(x.df.select(F.col("i").alias("at"), *extra, "x"), _rows(x))
        prod = self.df.join(side, F.col(on) == F.col("at")).select(F.col(to).alias("i"), *extra, V.mul(self.dtype, F.col("v"), F.col("x")).alias("x"))
        frame = self._places(n)
        shape: tuple[int, ...] = (n,)
        if "k" in extra:
            k = x.shape[-1]
            frame, shape = self.spark.range(n * k).select(F.floor(F.col("id") / max(k, 1)).alias("i"), (F.col("id") % max(k, 1)).alias("k")), (n, k)
        if "b" in extra:
            b, m = x.shape[0], n * (x.shape[-1] if "k" in extra else 1)
            each = self.spark.range(b * m).select(F.floor(F.col("id") / max(m, 1)).alias("b"), (F.col("id") % max(m, 1)).alias("r"))
            k = x.shape[-1] if "k" in extra else 1
            frame = each.select("b", F.floor(F.col("r") / max(k, 1)).alias("i"), (F.col("r") % max(k, 1)).alias("k"))
            shape = (b, *shape)
        return self._filled(prod, x.keys, frame, shape, x.batched)

    def _times_wide(self, x: Dense, on: str, to: str, n: int) -> Dense:
        """The same with the operand's few columns (of all batches) side by side: a cell makes one row, not one per column."""
        b, k = x.shape[0] if x.batched else 1, x.shape[-1] if "k" in x.keys else 1
        number = (F.col("b") * k if x.batched else F.lit(0)) + (F.col("k") if "k" in x.keys else F.lit(0))
        names = [f"x{t}" for t in range(b * k)]
        wide = x.df.groupBy(F.col("i").alias("at")).agg(*(F.sum(F.when(number == t, F.col("x"))).alias(name) for t, name in enumerate(names)))
        met = self.df.join(small(wide, x.shape[1 if x.batched else 0], 16 + 8 * len(names)), F.col(on) == F.col("at"))
        rows = met.select(F.col(to).alias("i"), *((F.col("v") * F.col(c)).alias(c) for c in names))
        zero = self._places(n).select("i", *(F.lit(0.0).alias(c) for c in names))
        sums = rows.union(zero).groupBy("i").agg(*(F.sum(c).alias(c) for c in names))
        long = sums.select("i", F.posexplode(F.array(*names)).alias("t", "x"))
        keys = [*([F.floor(F.col("t") / k).alias("b")] if x.batched else []), F.col("i"), *([(F.col("t") % k).cast("long").alias("k")] if "k" in x.keys else [])]
        shape = (*([b] if x.batched else []), n, *([k] if "k" in x.keys else []))
        return Dense(long.select(*keys, "x"), shape, self.dtype, x.batched)

    def matvec(self, x: object) -> Dense:
        """A @ x; empty rows give 0."""
        x = self._operand(x, self.n_cols)
        if x.batched or len(x.shape) != 1:
            raise ValueError("matvec takes a vector")
        return self._times(x, "j", "i", self.n_rows)

    def matvec_transpose(self, x: object) -> Dense:
        """A.T @ x: the join is on the other axis, nothing is transposed."""
        return self._times(self._operand(x, self.n_rows), "i", "j", self.n_cols)

    def rmatvec(self, x: object) -> Dense:
        return self.conj().matvec_transpose(x)

    def matmul(self, x: object) -> Dense:
        """A @ X for a dense matrix or a batch of them."""
        x = self._operand(x, self.n_cols)
        if "k" not in x.keys:
            raise ValueError("matmul takes an operand of rank 2 or more")
        return self._times(x, "j", "i", self.n_rows)

    def matmul_transpose(self, x: object) -> Dense:
        return self._times(self._operand(x, self.n_rows), "i", "j", self.n_cols)

    def batched_matvec(self, x: object) -> Dense:
        """Y[b] = A @ X[b] for an operand whose last dimension is the matrix's."""
        return self._times(self._operand(x, self.n_cols, batched=True), "j", "i", self.n_rows)

    def batched_matmul(self, x: object) -> Dense:
        x = self._operand(x, self.n_cols, batched=True)
        if "k" not in x.keys:
            raise ValueError("batched_matmul takes an operand of rank 3 or more")
        return self._times(x, "j", "i", self.n_rows)

    def matmat(self, other: SparseMatrix) -> SparseMatrix:
        """A @ B for a sparse B: canonical, cells that cancel exactly are not stored."""
        if not isinstance(other, SparseMatrix):
            raise TypeError(f"expected a sparse matrix, got {type(other).__name__}")
        if self.n_cols != other.n_rows:
            raise ValueError(f"dimension mismatch: {self.shape} @ {other.shape}")
        if self.dtype != other.dtype:
            raise TypeError(f"value types differ: {self.dtype} and {other.dtype}")
        most = other.n_rows * other.n_cols if other._stored is None else min(other._stored, other.n_rows * other.n_cols)
        small_right = most * 24 <= BROADCAST_BYTES
        if self.dtype != V.COMPLEX and (self._written and other._written or not small_right):
            if other._turned is self.df or self._turned is other.df:
                return self._gram()[0]
            return self._tiled(other)
        return self._joined(other, small_right)

    def _joined(self, other: SparseMatrix, small_right: bool = False) -> SparseMatrix:
        """The product by an equi-join."""
        # cells that share a place are summed before the join, which would otherwise repeat them for every partner
        a = self.canonicalize().df.select("i", F.col("j").alias("m"), F.col("v").alias("a"))
        b = other.canonicalize().df.select(F.col("i").alias("n"), "j", F.col("v").alias("b"))
        if small_right:
            # a task has a range of A's cells by row, so it sums nearly all of a row's products before they are shuffled
            met = a.repartitionByRange("i", "m").join(F.broadcast(b), F.col("m") == F.col("n"))
        else:
            met = self._split_join(a, b)
        out = met.groupBy("i", "j").agg(V.total(self.dtype, V.mul(self.dtype, F.col("a"), F.col("b"))).alias("v"))
        return self._like(out.filter(V.nonzero(self.dtype, F.col("v"))), (self.n_rows, other.n_cols), canonical=True)

    @property
    def _written(self) -> bool:
        """Whether the cells are summed and counted, so that reading them twice costs little."""
        return self.canonical and self._stored is not None

    def _tiled(self, other: SparseMatrix) -> SparseMatrix:
        """The product on a grid of tiles that fits the sizes of both sides and, where that matters, of the result."""
        a, b = (m if m._written else m.canonicalize().persist() for m in (self, other))
        cores = self.spark.sparkContext.defaultParallelism
        bound = a._stored * min(b._stored, b.n_cols)
        if bound <= products.PRODUCTS and a._stored + b._stored <= products.CELLS:  # small however the cells lie
            g = products.Grid(max(1, min(cores, a.n_rows, bound // 250_000)))
        else:
            with cleaned(self.spark):  # counts are of no use later
                facts = sizes.facts(a.df, b.df, a.n_rows, b.n_cols)
                g = products.grid(facts, cores)
                # cells sent often may cost more than parts of the result; how many these are is worth an estimate then
                if g.slabs == 1 and a._stored * g.cols + b._stored * g.rows > SENT * (a._stored + b._stored):
                    if facts.longest_inner <= products.CELLS:  # one task holds all cells of a contracted index
                        r, sent = products.route(a.df, b.df, facts, cores)
                        if sent <= SENT * (a._stored + b._stored):
                            parts = max(2 * cores, -(-facts.products // products.PRODUCTS), -(-sent // products.CELLS))
                            return self._like(products.routed(a.df, b.df, r, min(parts, r.rows * r.cols)), (self.n_rows, other.n_cols), canonical=True)
                    g = products.grid(facts, cores, sizes.product_cells(a.df, b.df))
        return self._like(products.tiled(a.df, b.df, g), (self.n_rows, other.n_cols), canonical=True)

    @staticmethod
    def _split_join(a: DataFrame, b: DataFrame) -> DataFrame:
        """a and b joined on m = n. An index with more than TASK_PRODUCTS products is split: a's cells by a hash of their row, b's to each part."""
        left, right = a.groupBy("m").agg(F.count("*").alias("x")), b.groupBy(F.col("n").alias("m")).agg(F.count("*").alias("y"))
        parts = F.least(F.ceil(F.col("x") * F.col("y") / TASK_PRODUCTS), F.col("x")).cast("int")
        heavy = cut(left.join(right, "m").filter(F.col("x") * F.col("y") > TASK_PRODUCTS).select("m", parts.alias("parts")))
        if heavy.isEmpty():
            release(heavy)
            return a.join(b, F.col("m") == F.col("n"))
        of = F.coalesce("parts", F.lit(1))
        a = a.join(heavy, "m", "left").withColumn("part", F.pmod(F.xxhash64("i"), of).cast("int")).drop("parts")
        b = b.join(heavy.withColumnRenamed("m", "n"), "n", "left").withColumn("part_b", F.explode(F.sequence(F.lit(0), of - 1))).drop("parts")
        return a.join(b, (F.col("m") == F.col("n")) & (F.col("part") == F.col("part_b")))

    def gram(self, written: bool = False) -> SparseMatrix:
        """A @ A.T; A's cells are summed once and written. written: the product is written too, and what it was made from deleted."""
        out, records = self._gram()
        if written:
            out = out.persist()
            release(records)
        return out

    def _gram(self) -> tuple[SparseMatrix, DataFrame]:
        """A @ A.T, and what was written of A for it."""
        if self.dtype != V.COMPLEX and self.n_rows and (records := products.recorded(self.df)) is not None:
            out = products.squared(records, self.n_rows, self.spark.sparkContext.defaultParallelism, SENT)
            if out is not None:
                return self._like(out, (self.n_rows, self.n_rows), canonical=True), records
            release(records)
        a = self.canonicalize().persist()
        return (a._joined if self.dtype == V.COMPLEX else a._tiled)(a.T), a.df

    def __matmul__(self, other: object) -> object:
        if isinstance(other, SparseMatrix):
            return self.matmat(other)
        x = dense(self.spark, other, None, V.COMPLEX if self.dtype == V.COMPLEX else None)
        return self.matvec(x) if len(x.shape) == 1 else self.batched_matmul(x) if x.batched else self.matmul(x)

    def product_rows(self, other: SparseMatrix) -> int:
        """How many products matmat makes: from one count per contracted index, before anything is joined."""
        a = self.canonicalize().df.groupBy(F.col("j").alias("m")).agg(F.count("*").alias("a"))
        b = other.canonicalize().df.groupBy(F.col("i").alias("m")).agg(F.count("*").alias("b"))
        return a.join(b, "m").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]

    # --- sums of matrices
    def __add__(self, other: object) -> SparseMatrix:
        from .assembly import add

        return add(self, other)

    __radd__ = __add__

    def __sub__(self, other: object) -> SparseMatrix:
        from .assembly import subtract

        return subtract(self, other)

    def __rsub__(self, other: object) -> SparseMatrix:
        from .assembly import subtract

        return subtract(other, self)


def _rows(x: Dense) -> int:
    n = 1
    for s in x.shape:
        n *= s
    return n


def check_format(layout: str | None) -> None:
    if layout is not None and not isinstance(layout, str):
        raise TypeError("a format is a string or None")
    if layout in ("bsr", "dia", "dok", "lil"):
        raise NotImplementedError(f"format {layout!r} is not supported")
    if layout not in (None, "coo", "csr", "csc"):
        raise ValueError(f"unknown format {layout!r}")


class COOArray(SparseMatrix):
    layout = "coo"


class CSRArray(SparseMatrix):
    layout = "csr"


class CSCArray(SparseMatrix):
    layout = "csc"


LAYOUTS: dict[str, type[SparseMatrix]] = {"coo": COOArray, "csr": CSRArray, "csc": CSCArray}


def issparse(x: object) -> bool:
    return isinstance(x, SparseMatrix)


