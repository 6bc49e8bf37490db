"""Readers of series in files, by Spark's readers alone, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..series import normalize_series

METADATA = T.StructType([
    T.StructField("algorithm", T.StringType()), T.StructField("algorithm_full_name", T.StringType()), T.StructField("algorithm_family", T.StringType()), T.StructField("paper_reference", T.StringType()),
    T.StructField("num_regimes", T.IntegerType()), T.StructField("regime_labels_map", T.MapType(T.StringType(), T.StringType())), T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("training_window_days", T.IntegerType()), T.StructField("features_used", T.ArrayType(T.StringType())), T.StructField("generated_at", T.StringType()), T.StructField("output_spec_version", T.StringType()),
])


def read_csv(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None, series_id: str | None = None) -> DataFrame:
    """A canonical series from CSV with a header; without a schema all columns are read as text and cast by name."""
    reader = spark.read.option("header", True)
    return normalize_series((reader.schema(schema) if schema else reader).csv(path), series_id)


def read_parquet(spark: SparkSession, path: str, *, series_id: str | None = None) -> DataFrame:
    """A canonical series from Parquet; a pandas index column counts as the date."""
    df = spark.read.parquet(path)
    return normalize_series(df.withColumnRenamed("__index_level_0__", "index"), series_id)


def read_first(spark: SparkSession, paths: list[str], *, series_id: str | None = None) -> DataFrame:
    """The first of the paths that exists, by its ending (Parquet, else CSV); raises FileNotFoundError if none does."""
    for path in paths:
        try:
            return (read_parquet if ".parquet" in path else read_csv)(spark, path, series_id=series_id)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"none of {paths}")


def read_any(spark: SparkSession, parquet: str, csv: str, **options) -> DataFrame:
    """Parquet if it is there, else CSV."""
    return read_first(spark, [parquet, csv], **options)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Run metadata of one or many JSON files; keys beyond the contract are ignored."""
    return spark.read.schema(METADATA).option("multiLine", True).json(path)


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ticker string").option("header", True).csv(path)


def with_benchmarks(df: DataFrame, **others: DataFrame) -> DataFrame:
    """Columns for further series (vix=..., safe=...), each a canonical series, joined on the date; missing days are null."""
    for name, other in others.items():
        side = other.select(F.col("ts").alias("_ts"), F.col("close").alias(name))
        df = df.join(side, F.col("ts") == F.col("_ts"), "left").drop("_ts")
    return df


def most_rows(df: DataFrame, n: int = 10, at_least: int = 0) -> DataFrame:
    """The n series with the most rows (ties by name), of those with ``at_least`` rows."""
    counts = df.groupBy("series_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= at_least).orderBy(F.desc("_n"), "series_id").limit(n)
    return df.join(F.broadcast(counts.select("series_id")), "series_id", "left_semi")
