"""Dense operands: vectors (i, x), matrices (i, k, x), and batches of either with a leading key b. All rows are there."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V


@dataclass(frozen=True)
class Dense:
    """shape counts the trailing dimensions: (n,), (n, k), or with the number of batches first."""

    df: DataFrame
    shape: tuple[int, ...]
    dtype: str = "float64"
    batched: bool = False

    @property
    def keys(self) -> list[str]:
        return [c for c in ("b", "i", "k") if c in self.df.columns]

    def collect(self) -> np.ndarray:
        """As a numpy array; for results whose size the caller knows."""
        complex_ = self.dtype == V.COMPLEX
        x = [F.col("x.re").alias("re"), F.col("x.im").alias("im")] if complex_ else ["x"]
        table = self.df.select(*self.keys, *x).toArrow()
        *at, = (table.column(n).to_numpy() for n in self.keys)
        out = np.zeros(self.shape, complex if complex_ else float)
        out[tuple(at)] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy() if complex_ else table.column("x").to_numpy()
        return out


def dense(spark: SparkSession, x: object, batched: bool | None = None, dtype: str | None = None) -> Dense:
    """A Dense from a Dense or an array; arrays of rank 3 and more are batches, their leading dimensions as one."""
    if isinstance(x, Dense):
        return x
    a = np.asarray(x)
    if a.ndim == 0:
        raise ValueError("a dense operand needs at least one dimension")
    kind = dtype or (V.COMPLEX if np.iscomplexobj(a) else "float64")
    if batched is None:
        batched = a.ndim > 2
    if batched:
        keep = 2 if a.ndim > 2 else 1
        a = a.reshape(-1, *a.shape[-keep:])
    names = (["b"] if batched else []) + ["i", "k"][: a.ndim - batched]
    at = np.indices(a.shape).reshape(a.ndim, -1)
    import pandas as pd

    flat = a.ravel()
    table = pd.DataFrame({n: c.astype(np.int64) for n, c in zip(names, at, strict=True)})
    if kind == V.COMPLEX:
        table["re"], table["im"] = flat.real.astype(float), flat.imag.astype(float)
        schema = ", ".join(f"{n} long" for n in names) + ", re double, im double"
        df = spark.createDataFrame(table, schema).select(*names, F.struct("re", "im").alias("x"))
    else:
        table["x"] = flat.astype(float)
        df = spark.createDataFrame(table, ", ".join(f"{n} long" for n in names) + ", x double")
    return Dense(df, a.shape, kind, batched)


def vector(df: DataFrame, n: int, dtype: str = "float64") -> Dense:
    """A vector from a frame (i, x) with a row for each of n places."""
    return Dense(df.select(F.col("i").cast("long"), F.col("x").cast(V.sql_type(dtype))), (n,), dtype)
