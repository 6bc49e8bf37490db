"""Regime profiles, names, confidences and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..series import expanding, ordered, whole


def profile(df: DataFrame, regime: str = "regime", ret: str = "ret") -> DataFrame:
    """(series_id, regime, n, mean_ret, vol, win_rate): mean and population deviation of returns, share of positive ones."""
    return df.groupBy("series_id", F.col(regime).alias("regime")).agg(
        F.count(ret).alias("n"), F.avg(ret).alias("mean_ret"), F.stddev_pop(ret).alias("vol"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"))


def moments(df: DataFrame, key: str = "seg", ret: str = "ret") -> DataFrame:
    """Per segment mean, sample deviation and bias-corrected skewness and excess kurtosis (null below 3 and 4 rows)."""
    n = F.count(ret).cast("double")
    skew = F.when(n > 2, F.skewness(ret) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))
    kurt = F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(ret) + 6))
    return df.groupBy("series_id", key).agg(F.count(ret).alias("n"), F.avg(ret).alias("mean_ret"), F.stddev_samp(ret).alias("vol"), skew.alias("skew"), kurt.alias("kurt"))


def name_by_volatility(stats: DataFrame) -> DataFrame:
    """bull: gains and volatility under the median; bear: losses and over it; else by the quartiles, else normal and the regime."""
    q = lambda p: F.percentile("vol", p).over(whole())
    mu, sd = F.col("mean_ret"), F.col("vol")
    return stats.withColumn("label", F.when((mu > 0) & (sd < q(0.5)), "bull").when((mu < 0) & (sd > q(0.5)), "bear").when(sd > q(0.75), "high_volatility").when(sd < q(0.25), "low_volatility").otherwise(F.concat(F.lit("normal_"), F.col("regime").cast("string"))))


def name_by_return(stats: DataFrame, names: tuple[str, ...] = ("bear", "sideways", "bull")) -> DataFrame:
    """Regimes in order of mean return take the names in order; of two the outer ones; more keep their rank as a suffix."""
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("mean_ret", "regime"))
    n = F.count("*").over(whole())
    given = F.get(F.array(*map(F.lit, names)), rank - 1)
    return stats.withColumn("rank", rank).withColumn("label", F.when(n == 1, names[len(names) // 2]).when(n == 2, F.when(rank == 1, names[0]).otherwise(names[-1])).otherwise(F.coalesce(given, F.concat(F.lit("regime_"), rank.cast("string")))))


def name_by_rank(stats: DataFrame) -> DataFrame:
    """Volatility rank and sign of the mean: low_vol / mid_vol / high_vol with _up or _down; a repeated name gets the regime as suffix."""
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("vol", "regime"))
    n = F.count("*").over(whole())
    level = F.when(rank == 1, "low_vol").when(rank == n, "high_vol").otherwise("mid_vol")
    stats = stats.withColumn("_name", F.concat(level, F.when(F.col("mean_ret") >= 0, "_up").otherwise("_down")))
    again = F.count("*").over(Window.partitionBy("series_id", "_name")) > 1
    return stats.withColumn("label", F.when(again, F.concat("_name", F.lit("_"), F.col("regime").cast("string"))).otherwise(F.col("_name"))).drop("_name")


def name_by_risk(stats: DataFrame) -> DataFrame:
    """In order of volatility, then falling return: the last is bear, the first bull, others sideways; of two by return."""
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("vol", F.desc("mean_ret"), "regime"))
    by_return = F.row_number().over(Window.partitionBy("series_id").orderBy("mean_ret", "regime"))
    n = F.count("*").over(whole())
    return stats.withColumn("label", F.when(n == 1, "sideways").when(n == 2, F.when(by_return == 1, "bear").otherwise("bull")).when(rank == n, "bear").when(rank == 1, "bull").otherwise("sideways"))


def cluster_means(stats: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Plain averages of regimes' averages by cluster, unweighted."""
    return stats.groupBy("series_id", cluster).agg(F.avg("mean_ret").alias("mean_ret"), F.avg("vol").alias("vol"), F.count("*").alias("n_regimes"))


def _clip(c, lo=0.0, hi=1.0):
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def score_confidence(df: DataFrame, score: str = "score", out: str = "confidence") -> DataFrame:
    """1 - score / largest score; without a score the last known one, at first 0.5."""
    c = _clip(1 - F.col(score) / F.max(score).over(whole()))
    return df.withColumn(out, F.coalesce(F.last(c, ignorenulls=True).over(expanding()), F.lit(0.5)))


def edge_confidence(df: DataFrame, seg: str = "seg", out: str = "confidence") -> DataFrame:
    """0.5 at the edges of the row's segment, up to 1 in its middle; 0.5 in segments of one row."""
    at = F.row_number().over(ordered("series_id", seg)) - 1
    n = F.count("*").over(whole("series_id", seg))
    near = F.least(at, n - 1 - at)
    return df.withColumn(out, F.when(n <= 1, 0.5).otherwise(_clip(0.5 + 0.5 * near / (n / 2.0))))


def ratio_confidence(df: DataFrame, own: str, nearest: str, out: str = "confidence") -> DataFrame:
    """Distance to the nearest other centre over that plus the own one's; without another centre 1."""
    return df.withColumn(out, F.coalesce(F.col(nearest) / (F.col(own) + F.col(nearest) + 1e-12), F.lit(1.0)))


def percentile_confidence(df: DataFrame, distance: str, out: str = "confidence") -> DataFrame:
    """1 less the distance's place between its 5th and 95th percentile, at least 0.1."""
    lo, hi = F.percentile(distance, 0.05).over(whole()), F.percentile(distance, 0.95).over(whole())
    return df.withColumn(out, F.when(hi > lo, _clip(1 - _clip((F.col(distance) - lo) / F.when(hi > lo, hi - lo)), 0.1)).otherwise(1.0))


def blended_confidence(df: DataFrame, distances: list[str], out: str = "confidence") -> DataFrame:
    """Half a posterior (exp of minus half the squared distance, normalised over centres), half 1 - nearest / largest square."""
    squares = [F.pow(F.col(d), 2) for d in distances]
    least = F.least(*squares) if len(squares) > 1 else squares[0]
    weights = [F.exp(-(s - least) / 2) for s in squares]
    total = sum(weights[1:], weights[0])
    return df.withColumn("_least", least).withColumn(out, _clip(0.5 / total + 0.5 * (1 - F.col("_least") / F.when(F.max("_least").over(whole()) > 0, F.max("_least").over(whole()))))).drop("_least")


def nearest_confidence(df: DataFrame, distance: str, out: str = "confidence") -> DataFrame:
    """1 - distance / largest distance; 0.5 where none is known (the warm-up)."""
    return df.withColumn(out, F.coalesce(_clip(1 - F.col(distance) / F.max(distance).over(whole())), F.lit(0.5)))


def score_share_confidence(df: DataFrame, score: str = "score", q: float = 0.99, out: str = "confidence") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.least(F.lit(1.0), F.col(score) / F.percentile(score, q).over(whole())), F.lit(0.5)))


def threshold_confidence(df: DataFrame, score: str = "score", threshold: str = "threshold", out: str = "confidence") -> DataFrame:
    return df.withColumn(out, _clip(F.col(score) / (2 * F.col(threshold))))


def forecasts(df: DataFrame, regime: str = "regime", ret: str = "ret", vol: str = "vol") -> DataFrame:
    """In-sample means of return and volatility by regime, on every row."""
    w = whole("series_id", regime)
    return df.withColumn("regime_return_forecast", F.avg(ret).over(w)).withColumn("regime_vol_forecast", F.avg(vol).over(w))
