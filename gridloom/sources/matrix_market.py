"""Matrix Market text files, and matrices as Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.dense import Dense
from ..operators.matrix import LAYOUTS, COOArray, SparseMatrix


def read_matrix_market(spark: SparkSession, path: str) -> COOArray | Dense:
    """A coordinate file (real, integer, complex or pattern; general, symmetric, skew-symmetric or hermitian), or an
    array file. Off-diagonal cells of the symmetric kinds are mirrored."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    kind = lines.orderBy("at").first()["line"].lower().split()
    if not kind or kind[0] != "%%matrixmarket":
        raise ValueError("not a Matrix Market file")
    layout, field, symmetry = kind[2:5]
    body = lines.filter(~F.col("line").startswith("%") & (F.col("line") != ""))
    head = body.orderBy("at").first()
    size = [int(x) for x in head["line"].split()]
    rows = body.filter(F.col("at") != head["at"]).select("at", F.split("line", r"\s+").alias("p"))
    if layout == "array":
        if symmetry != "general" or field == "complex":
            raise ValueError("only real general arrays are read")
        from pyspark.sql import Window as W

        ranked = rows.select(F.col("p")[0].cast("double").alias("x"), (F.row_number().over(W.orderBy("at")) - 1).alias("r"))  # an array file is dense and small
        return Dense(ranked.select((F.col("r") % size[0]).cast("long").alias("i"), F.floor(F.col("r") / size[0]).alias("k"), "x"), (size[0], size[1]))
    dtype = V.COMPLEX if field == "complex" else "float64"
    value = F.lit(1.0) if field == "pattern" else F.struct(F.col("p")[2].cast("double").alias("re"), F.col("p")[3].cast("double").alias("im")) if field == "complex" else F.col("p")[2].cast("double")
    df = rows.select((F.col("p")[0].cast("long") - 1).alias("i"), (F.col("p")[1].cast("long") - 1).alias("j"), value.alias("v"))
    if symmetry != "general":
        v = F.col("v")
        mirrored = V.conj(dtype, v) if symmetry == "hermitian" else V.mul(dtype, v, V.lit(dtype, -1)) if symmetry == "skew-symmetric" else v
        df = df.union(df.filter("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), mirrored.alias("v")))
    return COOArray(df, (size[0], size[1]), dtype=dtype)


def write_parquet(a: SparseMatrix, path: str) -> None:
    """Cells in the order of the layout, with shape, type and layout beside them."""
    outer = "j" if a.layout == "csc" else "i"
    a.df.repartitionByRange(outer).sortWithinPartitions(outer, "i", "j").write.mode("overwrite").parquet(f"{path}/cells")
    a.spark.createDataFrame([(a.n_rows, a.n_cols, a.dtype, a.layout, a.canonical)], "n_rows long, n_cols long, dtype string, layout string, canonical boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_parquet(spark: SparkSession, path: str) -> SparseMatrix:
    m = spark.read.parquet(f"{path}/meta").first()
    return LAYOUTS[m["layout"]](spark.read.parquet(f"{path}/cells").select("i", "j", "v"), (m["n_rows"], m["n_cols"]), dtype=m["dtype"], canonical=m["canonical"])
