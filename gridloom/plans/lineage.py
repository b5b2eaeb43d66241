"""Where a plan's lineage is cut, and what may be broadcast or collected."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that a join may broadcast; a side whose size isn't known to be below is shuffled.
BROADCAST_BYTES = 32 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and is one process."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cuts_dir(spark: SparkSession) -> str:
    """The folder of this application's cuts."""
    return f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, what: str = "matrix") -> DataFrame:
    """df written to the shared folder and read again: later stages don't repeat it, and survive lost executors."""
    spark = df.sparkSession
    path = f"{cuts_dir(spark)}/{what}-{uuid.uuid4().hex}"
    cut_at_exit()
    with cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What actions shuffle in here is deleted once they are done, as it is of no use then."""
    kept = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, kept)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_at_exit() -> None:
    """Whatever stands in the folder of cuts is deleted when the driver ends."""
    if not _cleared:
        _cleared.append(atexit.register(_at_exit))


def release(*frames: DataFrame) -> None:
    """Deletes what cut wrote for these frames; no plan may read them any more. Other frames are left alone."""
    for df in frames:
        if path := vars(df).pop("cut_path", None):
            delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes every cut of this application; results that were not written elsewhere are gone."""
    delete(spark, cuts_dir(spark))


_cleared: list = []


def _at_exit() -> None:
    """Cuts don't outlive their application: nothing can read them by name."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            clear(spark)
        except Exception:  # noqa: BLE001 - the gateway may be gone already
            pass


def small(df: DataFrame, rows: int | None, row_bytes: int = 24) -> DataFrame:
    """df with a broadcast hint if its number of rows is known and small enough."""
    return F.broadcast(df) if rows is not None and rows * row_bytes <= BROADCAST_BYTES else df
