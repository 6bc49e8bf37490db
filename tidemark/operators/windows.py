"""Window features over a series (returns, rolling moments, oscillators, trailing and centred statistics, votes).

Unless said otherwise an operator is causal: row i depends on rows up to i only. Those that look ahead say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import expanding, finite, ordered, rows, whole

TRADING_DAYS = 252


def log_return(df: DataFrame, n: int = 1, *, price: str = "close", out: str = "ret", first: str = "null") -> DataFrame:
    """ln(p_t / p_{t-n}); first: null keeps the head as null, zero fills it, drop removes it, guard takes |p| + 1e-12 first."""
    p = F.abs(F.col(price)) + 1e-12 if first == "guard" else F.when(F.col(price) > 0, F.col(price))
    r = F.log(p) - F.lag(F.log(p), n).over(ordered())
    df = df.withColumn(out, F.coalesce(r, F.lit(0.0)) if first == "zero" else r)
    return df.filter(F.col("i") > n) if first == "drop" else df


def simple_return(df: DataFrame, *, price: str = "close", out: str = "ret", fill: float | None = 0.0) -> DataFrame:
    r = F.col(price) / F.expr(f"nullif(lag({price}) over (partition by series_id order by i), 0)") - 1
    return df.withColumn(out, r if fill is None else F.coalesce(r, F.lit(fill)))


def _full(value: Column, c: str, w, at_least: int) -> Column:
    return F.when(F.count(F.col(c)).over(w) >= at_least, value)


def rolling_sum(df: DataFrame, c: str, n: int, out: str, min_periods: int = 1) -> DataFrame:
    return df.withColumn(out, _full(F.sum(c).over(rows(n)), c, rows(n), min_periods))


def rolling_mean(df: DataFrame, c: str, n: int, out: str, min_periods: int | None = None) -> DataFrame:
    return df.withColumn(out, _full(F.avg(c).over(rows(n)), c, rows(n), n if min_periods is None else min_periods))


def rolling_std(df: DataFrame, c: str, n: int, out: str, *, min_periods: int | None = None, annual: bool = False) -> DataFrame:
    """Sample deviation over a full window; annual scales by the root of 252."""
    s = F.stddev_samp(c).over(rows(n)) * (float(TRADING_DAYS) ** 0.5 if annual else 1.0)
    return df.withColumn(out, _full(s, c, rows(n), n if min_periods is None else min_periods))


def rolling_skew(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    """Bias-corrected skewness over a full window of n >= 3."""
    return df.withColumn(out, _full(finite(F.skewness(c).over(rows(n))) * F.lit((n * (n - 1)) ** 0.5 / (n - 2)), c, rows(n), n))


def rolling_kurt(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    """Bias-corrected excess kurtosis over a full window of n >= 4."""
    g = finite(F.kurtosis(c).over(rows(n)))
    return df.withColumn(out, _full(F.lit((n - 1) / ((n - 2) * (n - 3))) * (F.lit(n + 1.0) * g + 6.0), c, rows(n), n))


def up_fraction(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    up = F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double"))
    return df.withColumn(out, _full(F.avg(up).over(rows(n)), c, rows(n), n))


def drawdown(df: DataFrame, n: int, out: str, *, price: str = "close") -> DataFrame:
    high = F.max(price).over(rows(n))
    return df.withColumn(out, (F.col(price) - high) / (high + 1e-10))


def running_drawdown(df: DataFrame, out: str = "drawdown", *, price: str = "close", keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Distance from the running peak since the start of the series, or of the keys."""
    high = F.max(price).over(expanding(*keys))
    return df.withColumn("peak", high).withColumn(out, (F.col(price) - high) / high)


def vol_ratio(df: DataFrame, c: str, out: str = "vol_ratio", short: int = 5, long: int = 20) -> DataFrame:
    s = lambda n: _full(F.stddev_samp(c).over(rows(n)), c, rows(n), n)
    return df.withColumn(out, s(short) / (s(long) + 1e-10))


def rsi(df: DataFrame, n: int = 14, min_periods: int = 7, *, price: str = "close", out: str = "rsi") -> DataFrame:
    """100 - 100 / (1 + mean gain / mean loss); null while fewer than min_periods changes are known, and where no loss is."""
    df = df.withColumn("_d", F.col(price) - F.lag(price).over(ordered()))
    gain, loss = F.greatest(F.col("_d"), F.lit(0.0)), F.greatest(-F.col("_d"), F.lit(0.0))
    known = F.count("_d").over(rows(n)) >= min_periods
    g, l = F.avg(F.when(F.col("_d").isNotNull(), gain)).over(rows(n)), F.avg(F.when(F.col("_d").isNotNull(), loss)).over(rows(n))
    return df.withColumn(out, F.when(known & (l != 0), 100 - 100 / (1 + g / F.when(l != 0, l)))).drop("_d")


def volume_ratio(df: DataFrame, out: str = "volume_ratio", block: int | None = None) -> DataFrame:
    """Volume over its mean in the whole series (looks ahead), or in each block of so many rows."""
    keys = ["series_id"]
    if block:
        df, keys = df.withColumn("_b", F.floor((F.col("i") - 1) / block)), ["series_id", "_b"]
    return df.withColumn(out, F.col("volume") / (F.avg("volume").over(whole(*keys)) + 1e-12)).drop("_b")


def median_mad(df: DataFrame, c: str, n: int) -> DataFrame:
    """Centred rolling median and median absolute deviation about the row's own median (look ahead), n // 2 rows to each side; where
    the frame leaves the series the series' median stands in for the median."""
    h = n // 2
    w = ordered().rowsBetween(-h, h)
    df = df.withColumn("_all", F.percentile(c, 0.5).over(whole())).withColumn("_size", F.count("*").over(w))
    df = df.withColumn("median", F.when(F.col("_size") == 2 * h + 1, F.percentile(c, 0.5).over(w)).otherwise(F.col("_all"))).withColumn("_frame", F.collect_list(c).over(w))
    gaps = F.array_sort(F.transform("_frame", lambda x: F.abs(x - F.col("median"))))
    k = F.size(gaps)
    mid = (F.get(gaps, F.floor((k - 1) / 2).cast("int")) + F.get(gaps, F.floor(k / 2).cast("int"))) / 2
    return df.withColumn("mad", mid).drop("_all", "_size", "_frame")


def z_threshold(df: DataFrame, c: str, *, n: int = 504, k: float = 3.0, at_least: int = 20, out: str = "threshold") -> DataFrame:
    """Mean + k population deviations of the last n known values, the present one included; mean + 0.01 where they do not vary."""
    w = ordered().rowsBetween(-(n - 1), 0)
    mean, sd, known = F.avg(c).over(w), F.stddev_pop(c).over(w), F.count(c).over(w)
    return df.withColumn(out, F.when(known >= at_least, F.when(sd < 1e-12, mean + 0.01).otherwise(mean + k * sd)))


def quantile_threshold(df: DataFrame, c: str, *, n: int = 200, q: float = 0.95, at_least: int = 10, out: str = "threshold") -> DataFrame:
    """Quantile of the positive values among the n rows before the present one."""
    w = ordered().rowsBetween(-n, -1)
    x = F.when(F.col(c) > 0, F.col(c))
    return df.withColumn(out, F.when(F.count(x).over(w) >= at_least, F.percentile(x, q).over(w)))


def trailing_moments(df: DataFrame, c: str, back: int = 100) -> DataFrame:
    w = ordered().rowsBetween(-back, 0)
    return df.withColumn("mean", F.avg(c).over(w)).withColumn("var", F.var_pop(c).over(w)).withColumn("known", F.count(c).over(w))


def expanding_z(df: DataFrame, c: str, out: str = "z") -> DataFrame:
    z = (F.col(c) - F.avg(c).over(expanding())) / (F.stddev_samp(c).over(expanding()) + 1e-8)
    return df.withColumn(out, F.coalesce(finite(z), F.lit(0.0)))


def ema(df: DataFrame, c: str, alpha: float = 0.1, out: str = "ema") -> DataFrame:
    """Exponential mean seeded at the first value. Weights below 1e-17 are left out, which bounds the frame."""
    reach = 1
    while (1 - alpha) ** reach > 1e-17:
        reach += 1
    frame = F.collect_list(F.coalesce(F.col(c), F.lit(0.0))).over(rows(reach))
    folded = F.aggregate(F.slice(frame, 2, reach), F.get(frame, F.lit(0)), lambda acc, x: acc * (1 - alpha) + x * alpha)
    return df.withColumn(out, folded)


def sustained(df: DataFrame, flag: str, n: int = 3, at_least: int = 3, out: str = "sustained") -> DataFrame:
    return df.withColumn(out, (F.sum(F.col(flag).cast("int")).over(rows(n)) >= at_least).cast("int"))


def majority_vote(df: DataFrame, label: str, labels: list[int], n: int = 21, out: str = "vote") -> DataFrame:
    """The most frequent label of the n rows around the present one (looks ahead); of equally frequent ones the smallest."""
    w = ordered().rowsBetween(-(n // 2), n // 2)
    counts = {v: F.sum((F.col(label) == v).cast("int")).over(w) for v in sorted(labels)}
    if len(counts) == 1:
        return df.withColumn(out, F.lit(labels[0]))
    most = F.greatest(*counts.values())
    return df.withColumn(out, F.coalesce(*[F.when(c == most, F.lit(v)) for v, c in counts.items()]))


def change_flag(df: DataFrame, label: str, out: str = "transition_flag") -> DataFrame:
    """1 exactly where the label differs from the row before; the first row is 0."""
    return df.withColumn(out, F.coalesce((F.col(label) != F.lag(label).over(ordered())).cast("int"), F.lit(0)))


def regime_mean(df: DataFrame, regime: str = "regime", ret: str = "ret", *, train: int = 252, refit: int = 21, out: str = "regime_mean") -> DataFrame:
    """Mean return of the row's regime over all rows before the latest refit point (day ``train``, then every ``refit`` rows).

    A range frame over the number of the refit point ends before the present one, so one sort by (series, regime) does."""
    df = df.withColumn("_at", F.when(F.col("i") <= train, F.lit(0)).otherwise(F.floor((F.col("i") - train - 1) / refit) + 1).cast("long"))
    past = Window.partitionBy("series_id", regime).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.when(F.col("_at") > 0, F.avg(ret).over(past))).drop("_at")


def market_proxies(df: DataFrame, *, price: str = "close", vix: str | None = None) -> DataFrame:
    """Drawdown from the 252-row high, whether the 50-row mean is over the 200-row mean, and the vix level's 252-row mean + 2 deviations."""
    df = drawdown(df, 252, "drawdown_252", price=price)
    mean = lambda n: _full(F.avg(price).over(rows(n)), price, rows(n), n)
    df = df.withColumn("sma_cross", (mean(50) > mean(200)).cast("int"))
    if vix:
        df = df.withColumn("vix_limit", _full(F.avg(vix).over(rows(252)) + 2 * F.stddev_samp(vix).over(rows(252)), vix, rows(252), 252))
    return df


def named_features(df: DataFrame, *, price: str = "close") -> DataFrame:
    """The further features of the output contract by their textbook definitions: deviations of daily log returns (annualised by
    the root of 252), MACD 12/26 with signal 9, mean ratio 50/200, rate of change 20, volume z-score 20; with high and
    low also the range over the close and Parkinson's volatility (root of mean squared log range over 4 ln 2)."""
    df = log_return(df, out="_r")
    for n in (5, 60):
        df = rolling_std(df, "_r", n, f"daily_vol_{n}d", annual=True)
    df = ema(ema(df, price, 2 / 13, "_fast"), price, 2 / 27, "_slow").withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = ema(df, "macd", 2 / 10, "macd_signal")
    mean = lambda n: _full(F.avg(price).over(rows(n)), price, rows(n), n)
    df = df.withColumn("sma_50_200_ratio", mean(50) / mean(200)).withColumn("rate_of_change_20d", F.col(price) / F.lag(price, 20).over(ordered()) - 1)
    df = df.withColumn("volume_zscore_20d", _full((F.col("volume") - F.avg("volume").over(rows(20))) / F.expr("nullif(stddev_samp(volume) over (partition by series_id order by i rows between 19 preceding and current row), 0)"), "volume", rows(20), 20))
    if {"high", "low"} <= set(df.columns):
        df = df.withColumn("high_low_range", (F.col("high") - F.col("low")) / F.col(price)).withColumn("_hl", F.pow(F.log(F.col("high") / F.col("low")), 2))
        df = df.withColumn("parkinson_vol_20d", _full(F.sqrt(F.avg("_hl").over(rows(20)) / (4 * F.log(F.lit(2.0)))), "_hl", rows(20), 20)).drop("_hl")
    return drawdown(df.drop("_r", "_fast", "_slow"), 252, "spx_drawdown_252d", price=price)


def moment_features(df: DataFrame, *, price: str = "close", spans: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Returns' rolling mean, deviation, skewness, kurtosis, up fraction and sum, drawdowns and the volatility ratio."""
    df = log_return(df, price=price)
    for n in spans:
        df = rolling_mean(df, "ret", n, f"mean_{n}")
        df = rolling_std(df, "ret", n, f"std_{n}")
        df = rolling_skew(df, "ret", n, f"skew_{n}")
        df = rolling_kurt(df, "ret", n, f"kurt_{n}")
        df = up_fraction(df, "ret", n, f"up_{n}")
        df = rolling_sum(df, "ret", n, f"cum_{n}")
        df = drawdown(df, n, f"dd_{n}", price=price)
    return vol_ratio(df, "ret")
