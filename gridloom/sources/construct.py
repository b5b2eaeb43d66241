"""Matrices from frames, buffers, dense arrays and rules."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.dense import Dense, dense
from ..operators.matrix import COOArray, CSCArray, CSRArray, SparseMatrix, cells, check_format


def _checked(a: SparseMatrix, validate: object) -> SparseMatrix:
    if validate not in (False, True, "metadata", "full"):
        raise ValueError(f"validate must be False, True, 'metadata' or 'full', got {validate!r}")
    return a.validate() if validate in (True, "full") else a


def _from_arrays(spark: SparkSession, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[DataFrame, str]:
    import pandas as pd

    if not len(i) == len(j) == len(v):
        raise ValueError("buffers differ in length")
    at = {"i": np.asarray(i, np.int64), "j": np.asarray(j, np.int64)}
    if np.iscomplexobj(v):
        df = spark.createDataFrame(pd.DataFrame(at | {"re": v.real.astype(float), "im": v.imag.astype(float)}), "i long, j long, re double, im double")
        return df.select("i", "j", F.struct("re", "im").alias("v")), V.COMPLEX
    return spark.createDataFrame(pd.DataFrame(at | {"v": np.asarray(v, float)}), "i long, j long, v double"), "float64"


def coo_array(arg: object, shape: tuple[int, int], *, spark: SparkSession | None = None, validate: object = "metadata", canonical: bool | None = None, dtype: str | None = None) -> COOArray:
    """From a frame (i, j, v), buffers (data, (row, col)) or a COO matrix of that shape; duplicates and any order are fine."""
    if isinstance(arg, SparseMatrix):
        if arg.shape != tuple(shape):
            raise ValueError(f"the matrix has shape {arg.shape}, not {tuple(shape)}")
        return arg.tocoo()
    if isinstance(arg, DataFrame):
        kind = dtype or (V.COMPLEX if dict(arg.dtypes)["v"].startswith("struct") else "float64")
        return _checked(COOArray(cells(arg, dtype=kind), shape, dtype=kind, canonical=bool(canonical)), validate)
    data, (row, col) = arg
    df, kind = _from_arrays(_session(spark), np.asarray(row), np.asarray(col), np.asarray(data))
    return _checked(COOArray(df, shape, dtype=dtype or kind, canonical=bool(canonical), stored=len(np.asarray(data))), validate)


def _compressed(arg: object, shape: tuple[int, int], spark: SparkSession | None, validate: object, canonical: bool | None, dtype: str | None, by_row: bool) -> SparseMatrix:
    kind_of, n = (CSRArray, shape[0]) if by_row else (CSCArray, shape[1])
    if isinstance(arg, SparseMatrix):
        if arg.shape != tuple(shape):
            raise ValueError(f"the matrix has shape {arg.shape}, not {tuple(shape)}")
        return arg.tocsr() if by_row else arg.tocsc()
    if isinstance(arg, DataFrame):
        if "cells" in arg.columns:  # packed rows or columns
            a = "i" if by_row else "j"
            arg = arg.select(a, F.explode("cells").alias("c")).select(a, "c.*")
        kind = dtype or (V.COMPLEX if dict(arg.dtypes)["v"].startswith("struct") else "float64")
        return _checked(kind_of(cells(arg, dtype=kind), shape, dtype=kind, canonical=bool(canonical)), validate)
    data, indices, indptr = (np.asarray(x) for x in arg)
    if len(indptr) != n + 1 or (len(indptr) and indptr[0] != 0):
        raise ValueError(f"indptr must have {n + 1} entries and begin with 0")
    if (np.diff(indptr) < 0).any() or indptr[-1] != len(data):
        raise ValueError("indptr must not decrease and must end at the number of cells")
    outer = np.repeat(np.arange(n), np.diff(indptr))
    i, j = (outer, indices) if by_row else (indices, outer)
    df, kind = _from_arrays(_session(spark), i, j, data)
    return _checked(kind_of(df, shape, dtype=dtype or kind, canonical=bool(canonical), stored=len(data)), validate)


def csr_array(arg: object, shape: tuple[int, int], *, spark: SparkSession | None = None, validate: object = "metadata", sorted_indices: bool = False, canonical: bool | None = None, dtype: str | None = None) -> CSRArray:
    """From (data, indices, indptr), a frame of cells or of packed rows, or a matrix. Sortedness needs no flag here: cells have no order."""
    return _compressed(arg, shape, spark, validate, canonical, dtype, True)


def csc_array(arg: object, shape: tuple[int, int], *, spark: SparkSession | None = None, validate: object = "metadata", sorted_indices: bool = False, canonical: bool | None = None, dtype: str | None = None) -> CSCArray:
    """The same by columns."""
    return _compressed(arg, shape, spark, validate, canonical, dtype, False)


def _session(spark: SparkSession | None) -> SparkSession:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no Spark session is active")
    return spark


def fromdense(spark: SparkSession, array: object, *, threshold: float = 0.0, dtype: str | None = None) -> CSRArray:
    """The cells of a dense matrix that aren't zero (with a threshold: whose magnitude is above it), canonical.

    array: a Dense, an array of rank 2, or a frame (i, row) of arrays with attribute-free rows."""
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    if isinstance(array, DataFrame):
        rows = array.select(F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "v"))
        n_rows, n_cols = array.agg(F.coalesce(F.max("i") + 1, F.lit(0)), F.coalesce(F.max(F.size("row")), F.lit(0))).first()
        df, shape, kind = cells(rows), (n_rows, n_cols), "float64"
    else:
        if not isinstance(array, Dense) and np.ndim(array) != 2:
            raise ValueError("a dense matrix has rank 2")
        x = dense(spark, array)
        df, shape, kind = x.df.select("i", F.col("k").alias("j"), F.col("x").alias("v")), x.shape, x.dtype
    size = F.sqrt(V.square(kind, F.col("v"))) if kind == V.COMPLEX else F.abs("v")
    keep = V.nonzero(kind, F.col("v")) if threshold == 0 else (size > threshold) & ~F.isnan(size)  # Spark orders NaN above all numbers
    return CSRArray(df.filter(keep), shape, dtype=dtype or kind, canonical=True)


from_dense = from_numpy = fromdense


def from_scipy(spark: SparkSession, matrix: object, *, format: str = "csr", dtype: str | None = None, canonical: bool = True) -> SparseMatrix:
    """From anything with tocoo(), row, col and data."""
    check_format(format)
    if not hasattr(matrix, "tocoo"):
        raise TypeError(f"expected a matrix with tocoo(), got {type(matrix).__name__}")
    coo = matrix.tocoo()
    a = coo_array((coo.data, (coo.row, coo.col)), coo.shape, spark=spark, dtype=dtype)
    return (a.sum_duplicates() if canonical else a).asformat(format)


def asarray(spark: SparkSession, x: object, *, threshold: float = 0.0, dtype: str | None = None) -> SparseMatrix:
    """CSR and CSC stay, COO becomes canonical CSR, dense arrays are cut at the threshold."""
    if isinstance(x, COOArray):
        return x.tocsr(canonical=True)
    if isinstance(x, SparseMatrix):
        return x
    return from_scipy(spark, x, dtype=dtype) if hasattr(x, "tocoo") else fromdense(spark, x, threshold=threshold, dtype=dtype)


def eye(spark: SparkSession, n: int, m: int | None = None, *, k: int = 0, dtype: str = "float64") -> CSRArray:
    """Ones on diagonal k."""
    m = n if m is None else m
    if n < 0 or m < 0:
        raise ValueError("dimensions must not be negative")
    length = max(0, min(n - max(0, -k), m - max(0, k)))
    df = spark.range(length).select((F.col("id") + max(0, -k)).alias("i"), (F.col("id") + max(0, k)).alias("j"), V.lit(dtype, 1).alias("v"))
    return CSRArray(df, (n, m), dtype=dtype, canonical=True, stored=length)


def identity(spark: SparkSession, n: int, dtype: str = "float64", format: str | None = None) -> SparseMatrix:
    return eye(spark, n, dtype=dtype).asformat(format)


def diags(spark: SparkSession, diagonals: object, offsets: int | Sequence[int] = 0, *, shape: Sequence[int] | None = None, dtype: str | None = None) -> CSRArray:
    """Diagonals at offsets, each read from its first value on; without a shape the smallest square that holds them."""
    if np.ndim(offsets) == 0:
        offsets = [int(offsets)]
        diagonals = [diagonals]
    given = [np.atleast_1d(np.asarray(d)) for d in diagonals]
    offsets = [int(k) for k in offsets]
    if len(given) != len(offsets):
        raise ValueError("as many diagonals as offsets are needed")
    if len(set(offsets)) != len(offsets):
        raise ValueError("offsets must differ")
    if any(d.ndim != 1 for d in given):
        raise ValueError("a diagonal has rank 1")
    if shape is None:
        n = max(len(d) + abs(k) for d, k in zip(given, offsets, strict=True))
        shape = (n, n)
    rows, cols, data = [], [], []
    for d, k in zip(given, offsets, strict=True):
        length = max(0, min(shape[0] - max(0, -k), shape[1] - max(0, k)))
        if len(d) == 1 and length > 1 and np.ndim(diagonals[0]) == 0:
            d = np.repeat(d, length)
        if len(d) > length:
            raise ValueError(f"diagonal {k} has {len(d)} values, {length} fit")
        at = np.arange(len(d))
        rows.append(at + max(0, -k))
        cols.append(at + max(0, k))
        data.append(d)
    df, kind = _from_arrays(spark, np.concatenate(rows), np.concatenate(cols), np.concatenate(data))
    return CSRArray(df, tuple(shape), dtype=dtype or kind, canonical=True)
