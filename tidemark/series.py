"""The canonical series table and its adapters.

A series table has series_id, ts (date), i (ordinal from 1 within the series), close and volume; every operator is
partitioned by series_id and ordered by i, so one ordering serves a whole plan. Floating NaN becomes null on the way in.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("ts", T.DateType()), T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()), T.StructField("adj_close", T.DoubleType()), T.StructField("volume", T.LongType()),
])
#: Column names under which inputs bear the canonical columns, first match wins.
ALIASES = {"series_id": ("series_id", "symbol", "ticker"), "ts": ("ts", "date", "datetime", "index"), "close": ("adj_close", "adj close", "close", "sp500", "price"), "volume": ("volume",)}


def rows(n: int, *keys: str) -> WindowSpec:
    """The last n rows of the series, the present one included."""
    return Window.partitionBy(*(keys or ("series_id",))).orderBy("i").rowsBetween(-(n - 1), 0)


def ordered(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("series_id",))).orderBy("i")


def expanding(*keys: str) -> WindowSpec:
    return ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)


def whole(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("series_id",)))


def finite(c: Column) -> Column:
    """c, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def with_ordinal(df: DataFrame, *, bucket: Column | None = None) -> DataFrame:
    """Add i. With ``bucket`` (a coarse, order-preserving function of ts) a long series is numbered by many tasks:
    rows are numbered within a bucket and the buckets' counts, one row each, are summed up before it."""
    if bucket is None:
        return df.withColumn("i", F.row_number().over(Window.partitionBy("series_id").orderBy("ts")).cast("int"))
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy("series_id", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("series_id", "_bucket", (F.sum("_n").over(Window.partitionBy("series_id").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("series_id", "_bucket").orderBy("ts"))
    return marked.withColumn("_local", local).join(before, ["series_id", "_bucket"]).withColumn("i", (F.col("_local") + F.col("_before")).cast("int")).drop("_bucket", "_local", "_before")


def chunked(df: DataFrame, length: int, history: int) -> DataFrame:
    """Split long series into chunks of ``length`` rows, each with the ``history`` rows before it (own = false).

    Frames of at most history + 1 rows then partition by (series_id, chunk), so a series of any length is many tasks;
    filter on own afterwards."""
    last = F.floor((F.col("i") + F.lit(history) - 1) / length)
    chunk = F.floor((F.col("i") - 1) / length)
    out = df.withColumn("chunk", F.explode(F.sequence(chunk, last)))
    return out.withColumn("own", F.col("chunk") == chunk)


def normalize_series(df: DataFrame, series_id: str | None = None) -> DataFrame:
    """A canonical table from any input with a date and a price column (names by ALIASES, in any case).

    Unknown series become one called ``series``; rows without a date go; NaN, infinite and missing prices are null."""
    have = {c.lower(): c for c in df.columns}
    pick = lambda name: next((have[a] for a in ALIASES[name] if a in have), None)
    key, ts, close, volume = (pick(n) for n in ("series_id", "ts", "close", "volume"))
    if ts is None or close is None:
        raise ValueError(f"no date or price column among {df.columns}")
    out = df.select(
        (F.lit(series_id) if series_id else F.col(f"`{key}`").cast("string") if key else F.lit("series")).alias("series_id"), F.to_date(F.col(f"`{ts}`")).alias("ts"),
        finite(F.col(f"`{close}`").cast("double")).alias("close"), (F.col(f"`{volume}`").cast("long") if volume else F.lit(None).cast("long")).alias("volume"))
    return with_ordinal(out.filter(F.col("ts").isNotNull()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order price as one series."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("ts"), "o_totalprice")
    return with_ordinal(o.groupBy("ts").agg(F.avg("o_totalprice").alias("close"), F.count("*").alias("volume")).withColumn("series_id", F.lit("orders")))


def segment_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order price for each market segment."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("ts"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("series_id"))
    return with_ordinal(o.join(c, o.o_custkey == c.c_custkey).groupBy("series_id", "ts").agg(F.avg("o_totalprice").alias("close"), F.count("*").alias("volume")))


def events_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean value for each type of event, over hours that have any (ts is the hour)."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"), "value")
    return with_ordinal(e.groupBy("series_id", "ts").agg(F.avg("value").alias("close"), F.count("*").alias("volume")))


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in ``spark.checkpoint.dir``: for what a plan uses several times, as fits and self-joins do.

    Where that is unset, a local session (tests) gets a new folder; on a cluster it raises, as executors would not share it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()
