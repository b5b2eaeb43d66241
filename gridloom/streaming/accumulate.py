"""A matrix that grows with a stream: cells add up, so each batch is summed and united with what there was."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matrix import COOArray, cells
from ..plans.lineage import shared_dir


def running_sums(stream: DataFrame, watermark: tuple[str, str] | None = None, window: str | None = None) -> DataFrame:
    """Cells (i, j, v) of a stream, summed per place, and per event-time window if one is given."""
    if watermark:
        stream = stream.withWatermark(*watermark)
    keys = [F.window(watermark[0], window).alias("window")] if window else []
    return stream.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


class Accumulator:
    """Keeps the sum of all batches as a table; each batch writes a new version, and a batch that comes again after a
    failure is recognised by its number."""

    def __init__(self, spark, shape: tuple[int, int]):
        self.spark, self.shape = spark, shape
        self.folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        self.version = -1

    def add(self, batch: DataFrame, number: int) -> None:
        if number <= self.version:
            return
        rows = cells(batch)
        if self.version >= 0:
            rows = rows.union(self.spark.read.parquet(f"{self.folder}/{self.version}"))
        rows.groupBy("i", "j").agg(F.sum("v").alias("v")).write.mode("overwrite").parquet(f"{self.folder}/{number}")
        self.version = number

    def start(self, stream: DataFrame) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.folder}/offsets").trigger(availableNow=True).start()

    def matrix(self) -> COOArray:
        if self.version < 0:
            return COOArray(self.spark.createDataFrame([], "i long, j long, v double"), self.shape, canonical=True)
        return COOArray(self.spark.read.parquet(f"{self.folder}/{self.version}"), self.shape, canonical=True)
