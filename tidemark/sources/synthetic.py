"""Synthetic prices with a fixed seed (values differ from other generators with that seed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..series import expanding


def _days(spark: SparkSession, n: int, series: int) -> DataFrame:
    base = spark.range(series).select(F.concat(F.lit("path"), F.col("id").cast("string")).alias("series_id"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    return base.withColumn("ts", F.date_add(F.lit("2000-01-03").cast("date"), F.col("i") - 1))


def _uniform(seed: int, salt: int):
    """A uniform number from the row's own key, the same however rows are dealt to tasks."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "series_id", "i"), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(seed: int, salt: int):
    return F.sqrt(-2 * F.log(_uniform(seed, salt))) * F.cos(2 * F.lit(3.141592653589793) * _uniform(seed, salt + 1))


def gbm_path(spark: SparkSession, n: int, mu: float = 0.0, sigma: float = 0.2, *, dt: float = 1 / 252, seed: int = 42, series: int = 1, start: float = 100.0) -> DataFrame:
    df = _days(spark, n, series).withColumn("_z", _normal(seed, 0))
    step = F.when(F.col("i") > 1, (mu - sigma * sigma / 2) * dt + sigma * dt**0.5 * F.col("_z")).otherwise(0.0)
    return df.withColumn("close", start * F.exp(F.sum(step).over(expanding()))).withColumn("volume", F.lit(None).cast("long")).drop("_z")


def switching_path(spark: SparkSession, n: int = 1000, params: tuple[tuple[float, float], ...] = ((0.0, 0.15), (0.0, 0.35)), p: float = 0.01, *, dt: float = 1 / 252, seed: int = 42, series: int = 1, start: float = 100.0) -> DataFrame:
    """Geometric motion whose (drift, volatility) moves on to the next of ``params`` with probability p a day; true_regime tells which."""
    df = _days(spark, n, series).withColumn("_z", _normal(seed, 0)).withColumn("_s", ((F.col("i") > 1) & (_uniform(seed, 7) < p)).cast("int"))
    df = df.withColumn("true_regime", (F.sum("_s").over(expanding()) % len(params)).cast("int"))
    pick = lambda j: F.get(F.array(*[F.lit(float(x[j])) for x in params]), F.col("true_regime"))
    mu, sigma = pick(0), pick(1)
    step = F.when(F.col("i") > 1, (mu - sigma * sigma / 2) * dt + sigma * dt**0.5 * F.col("_z")).otherwise(0.0)
    return df.withColumn("close", start * F.exp(F.sum(step).over(expanding()))).withColumn("volume", F.lit(None).cast("long")).drop("_z", "_s")


def or_synthetic(spark: SparkSession, read, n: int = 1000) -> DataFrame:
    """read() or, where its file is missing, a switching path."""
    try:
        return read()
    except FileNotFoundError:
        return switching_path(spark, n)
