"""Shared helpers: staged tables in the cluster's shared folder and ASCII word rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: Bytes of rows that Spark hands to a Python worker at a time, where the session leaves Spark's default (64 MB) in force.
BATCH_BYTES = 8 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what was given to ``setCheckpointDir``.

    Where neither is set, a local session (tests) gets a new folder; on a cluster it raises, as a local folder would be another
    one on each machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex[:12]}-{label}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, all else untouched. ``lower`` is exact, and much faster, where every character is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


#: Tables of at most so many rows (of under 100 bytes), or so many elements of 16 bytes in their lists, are sent to all tasks;
#: larger ones are joined by a shuffle. Either is 20 MB at most.
SMALL, ELEMENTS = 200_000, 1_000_000


def sized(df: DataFrame, lists: str | None = None) -> DataFrame:
    """``df``, which must be staged, marked for broadcasting if it is small by its rows and by the elements of its column ``lists``."""
    if df.limit(SMALL + 1).count() > SMALL:
        return df
    if lists and (df.agg(F.sum(F.size(lists))).first()[0] or 0) > ELEMENTS:
        return df
    return F.broadcast(df)


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bounded(spark: SparkSession) -> None:
    """Bound the bytes of a batch for Python workers, unless the session has set a bound of its own: batches of long texts
    are what takes memory on both sides, and smaller ones cost no measurable time."""
    if spark.conf.get(_BATCH, None) in (None, _BATCH_DEFAULT):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers give their memory back after each task."""
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    bounded(df.sparkSession)
    return df.mapInArrow(tidy, schema)
