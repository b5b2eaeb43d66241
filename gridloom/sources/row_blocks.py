"""Matrices stored in blocks of rows, for products that are made again and again.

A block is one record: the cells of some rows, in order, as arrays (rows as steps from the block's first, so that they take
a byte or two in the files). The records are a table bucketed by block. A product unpacks them where they lie: sums by block
and row need no exchange, as rows of one block are in one bucket, so the matrix is read but never sent. A small vector is
broadcast; of a large one each block gets the values that its columns need (the halo, stored with the matrix and bucketed by
column), which is an exchange of these values only. A row with more cells than a block should hold is several blocks; only
then are sums of blocks added up by row, an exchange of results. Rows without cells hold a zero, so results are complete."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.dense import Dense, dense
from ..operators.matrix import SparseMatrix
from ..plans.lineage import BROADCAST_BYTES, cut, cut_at_exit, cuts_dir, delete, release

#: Cells of a block, about, and of a row that is not split.
CELLS = 1 << 16
#: Without this, a join on block and column would exchange a table that is bucketed by block alone.
_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def _packed(most: int):
    """Over cells (b, i, j, v) in this order: a record for each block, or several where it has more than so many cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records(cells: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            b, i = (cells.column(n).to_numpy() for n in ("b", "i"))
            ends = np.append(starts, len(b))
            steps = i - np.repeat(i[starts], np.diff(ends))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(steps, pa.int32()), *(cells.column(n).combine_chunks() for n in ("j", "v")))]
            return pa.RecordBatch.from_arrays([pa.array(b[starts]), pa.array(i[starts]), *lists], names=["b", "first", "rows", "cols", "vals"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch]).rename_columns(["b", "i", "j", "v"])
            held = new if held is None else pa.concat_tables([held, new])
            b = held.column("b").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1])
            last = len(b) if len(b) - starts[-1] >= most else int(starts[-1])  # the last block may go on in the next batch
            if last:
                yield records(held.slice(0, last), starts[starts < last])
                held = held.slice(last) if last < len(b) else None
        if held is not None:
            yield records(held, np.zeros(1, np.int64))

    return run


class RowBlocks:
    """A real matrix in blocks of rows. Its tables are files in the folder of cuts, until drop() or the driver's end."""

    def __init__(self, a: SparseMatrix, *, cells: int = CELLS, buckets: int | None = None):
        if a.dtype == V.COMPLEX:
            raise TypeError("row blocks hold real values")
        self.spark, self.shape, n = a.spark, a.shape, a.n_rows
        a = a if a._written else a.canonicalize().persist()
        self.block = max(1, min(n, cells * n // max(1, a._stored)))
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"gridloom_blocks_{uuid.uuid4().hex}"
        # one row of counts for each row of the matrix; long rows get a number of parts
        count = a.df.groupBy("i").agg(F.count("*").alias("c"))
        heavy = cut(count.filter(F.col("c") > cells).select("i", F.ceil(F.col("c") / cells).cast("int").alias("parts")), "heavy")
        self.split = not heavy.isEmpty()
        empty = self.spark.range(n).select(F.col("id").alias("i")).join(count, "i", "left_anti").select("i", F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("v"))
        every = a.df.select("i", "j", "v").union(empty if a.n_cols else empty.limit(0)).withColumn("b", F.floor(F.col("i") / self.block))
        if self.split:  # parts have numbers of their own, below zero; two that share one are one block, which harms nothing
            part = -1 - F.xxhash64("i", F.pmod(F.xxhash64("j"), F.col("parts"))).bitwiseAND((1 << 62) - 1)
            every = every.join(heavy, "i", "left").withColumn("b", F.when(F.col("parts").isNotNull(), part).otherwise(F.col("b"))).drop("parts")
        dealt = every.filter("i is not null").select(F.col("b").cast("long"), "i", "j", F.col("v").cast("double")).repartition(self.buckets, "b").sortWithinPartitions("b", "i", "j")
        self._save(dealt.mapInArrow(_packed(cells), "b long, first long, rows array<int>, cols array<long>, vals array<double>"), "b", self.name)
        self._halo = False
        release(heavy)

    def _save(self, df: DataFrame, key: str, name: str) -> None:
        """df, which is dealt by key already."""
        cut_at_exit()
        df.write.format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", f"{cuts_dir(self.spark)}/{name}").saveAsTable(name)

    @property
    def cells(self) -> DataFrame:
        """(b, i, j, v), unpacked where the blocks lie."""
        cell = F.explode(F.arrays_zip("rows", "cols", "vals")).alias("c")
        return self.spark.table(self.name).select("b", "first", cell).select("b", (F.col("first") + F.col("c.rows")).alias("i"), F.col("c.cols").alias("j"), F.col("c.vals").alias("v"))

    def matvec(self, x: object, *, broadcast: bool | None = None) -> Dense:
        """A @ x. broadcast: by default whether the vector is known to be small."""
        x = dense(self.spark, x)
        if x.shape != (self.shape[1],):
            raise ValueError(f"expected a vector of {self.shape[1]}, got shape {x.shape}")
        side = x.df.select(F.col("i").alias("j"), "x")
        if x.shape[0] * 24 <= BROADCAST_BYTES if broadcast is None else broadcast:
            met = self.cells.join(F.broadcast(side), "j")
        else:
            self.spark.conf.set(_KEYS, "false")
            met = self.cells.join(self._needed(side), ["b", "j"])
        sums = met.groupBy("b", "i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))
        sums = sums.groupBy("i").agg(F.sum("x").alias("x")) if self.split else sums.select("i", "x")
        return Dense(sums, (self.shape[0],))

    __matmul__ = matvec

    def _needed(self, side: DataFrame) -> DataFrame:
        """(b, j, x): the vector's values that each block needs."""
        if not self._halo:
            self._save(self.cells.select("b", "j").distinct().repartition(self.buckets, "j").sortWithinPartitions("j"), "j", f"{self.name}_halo")
            self._halo = True
        return self.spark.table(f"{self.name}_halo").join(side, "j").select("b", "j", "x").hint("shuffle_merge")

    def tocsr(self) -> SparseMatrix:
        from ..operators.matrix import CSRArray

        return CSRArray(self.cells.select("i", "j", "v").filter("v != 0"), self.shape, canonical=True)

    def drop(self) -> None:
        for name in (self.name, f"{self.name}_halo"):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{cuts_dir(self.spark)}/{name}")
