"""The scoring suite: separability, stability, alignment, walk-forward allocation, responsiveness, composite.

mode rubric is the default; mode plan has the plan's variants of the same metrics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import ordered, rows, whole
from .kernels import _blocked
from .segments import segments
from .windows import log_return, market_proxies, regime_mean, rolling_std, rolling_sum


def _linear(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the points, flat beyond them."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, ya), (b, yb) in zip(points, points[1:]):
        out = out.when(x <= b, F.lit(ya) + (x - a) * ((yb - ya) / (b - a)))
    return out.otherwise(F.lit(points[-1][1]))


def silhouette(df: DataFrame, columns: list[str], label: str, *, blocks: int = 4) -> DataFrame:
    """(n, labels, silhouette): the mean Euclidean silhouette over all rows, exact, block against block.

    A row's sums of distances to each label are partial sums over blocks, so no task holds more than two blocks."""
    known = df.dropna(subset=[*columns, label]).select(F.monotonically_increasing_id().alias("id"), F.col(label).cast("int").alias("label"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1)
        side, labels, ids = (table.column(c).to_numpy() for c in ("side", "label", "id"))
        out = []
        for mine, theirs in {(key[0].as_py(), key[1].as_py()), (key[1].as_py(), key[0].as_py())}:
            a, b = np.nonzero(side == mine)[0], np.nonzero(side == theirs)[0]
            for i in range(0, len(a), 1024):
                rows_ = a[i:i + 1024]
                d = np.sqrt(np.maximum(((x[rows_][:, None, :] - x[b][None]) ** 2).sum(2), 0)) if x.shape[1] < 8 else np.sqrt(np.maximum((x[rows_] ** 2).sum(1)[:, None] + (x[b] ** 2).sum(1)[None] - 2 * x[rows_] @ x[b].T, 0))
                for v in np.unique(labels[b]):
                    out += list(zip(ids[rows_].tolist(), labels[rows_].tolist(), [int(v)] * len(rows_), d[:, labels[b] == v].sum(1).tolist()))
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["id", "label", "other", "s"])

    dealt = _blocked(known, "v", blocks, ["id", "label"])
    sums = dealt.groupBy("p", "q").applyInArrow(run, "id long, label int, other int, s double").groupBy("id", "label", "other").agg(F.sum("s").alias("s"))
    counts = known.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("n"))
    means = sums.join(F.broadcast(counts), "other").withColumn("m", F.when(F.col("label") == F.col("other"), F.col("s") / F.when(F.col("n") > 1, F.col("n") - 1)).otherwise(F.col("s") / F.col("n")))
    row = means.groupBy("id").agg(F.max(F.when(F.col("label") == F.col("other"), F.col("m"))).alias("a"), F.min(F.when(F.col("label") != F.col("other"), F.col("m"))).alias("b"), F.countDistinct("other").alias("labels"))
    value = F.when(F.col("a").isNull(), 0.0).when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return row.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.avg(F.when(F.col("b").isNotNull(), value)).alias("silhouette"))


def separability_score(s: Column, mode: str = "rubric") -> Column:
    """25 points from a silhouette of 0.5 on, piecewise linear (rubric), or 25 max(0, s) (plan); unknown is 0."""
    s = F.coalesce(s, F.lit(0.0))
    if mode == "plan":
        return 25 * F.greatest(s, F.lit(0.0))
    return _linear(s, [(0.0, 0.0), (0.05, 5.0), (0.15, 10.0), (0.3, 20.0), (0.5, 25.0)])


def separability_features(df: DataFrame, *, n: int = 20) -> DataFrame:
    df = log_return(df)
    return rolling_std(rolling_sum(df, "ret", n, "ret_20", n), "ret", n, "vol_20", annual=True)


def stability(df: DataFrame, label: str = "regime", mode: str = "rubric") -> DataFrame:
    """(series_id, n_days, segments, mean_dwell, transition_rate, score) of 15 points.

    Full marks from a mean dwell of 21 days; under 60 days of data the ideal is max(5, days / 12) and the steps below it scale along.
    Under two days the score is 0 (rubric) or linear (plan). Rates of change over 10, 20 and 30 % cut the score (rubric), over
    30 % void it (both). A single regime is 12 (rubric) or 10 (plan)."""
    runs = segments(df, label).groupBy("series_id").agg(F.sum("n_days").alias("n_days"), F.count("*").alias("segments"))
    runs = runs.withColumn("mean_dwell", F.col("n_days") / F.col("segments")).withColumn("transition_rate", (F.col("segments") - 1) / F.greatest(F.col("n_days") - 1, F.lit(1)))
    ideal = F.when(F.col("n_days") < 60, F.greatest(F.lit(5.0), F.col("n_days") / 12)).otherwise(21.0)
    d = F.col("mean_dwell") * 21 / ideal
    low = F.when(d < 2, 0.0 if mode == "rubric" else d).otherwise(d)
    base = F.when(d >= 21, 15.0).when(d >= 10, 10 + (d - 10) / 11 * 5).when(d >= 5, 5 + (d - 5) / 5 * 5).otherwise(low)
    r = F.col("transition_rate")
    cut = F.when(r > 0.3, 0.0).when(r > 0.2, 0.5).when(r > 0.1, 0.8).otherwise(1.0) if mode == "rubric" else F.when(r > 0.3, 0.0).otherwise(1.0)
    return runs.withColumn("score", F.when(F.col("segments") == 1, 12.0 if mode == "rubric" else 10.0).otherwise(base * cut))


def adjusted_rand(df: DataFrame, a: str, b: str, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, ari) from the contingency table of two labels; rows with a null label are left out."""
    pairs = df.dropna(subset=[a, b]).groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").cast("double").alias("n"))
    comb = lambda c: F.col(c) * (F.col(c) - 1) / 2
    by = lambda c: pairs.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(comb("n")).alias(f"s{c}"))
    cells = pairs.groupBy(*keys).agg(F.sum(comb("n")).alias("s"), F.sum("n").alias("n"))
    one = F.lit(1).alias("_one")
    joined = cells.join(by("_a"), list(keys)).join(by("_b"), list(keys)) if keys else cells.select("*", one).join(by("_a").select("*", one), "_one").join(by("_b").select("*", one), "_one")
    expected = F.col("s_a") * F.col("s_b") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("s_a") + F.col("s_b")) / 2
    return joined.select(*keys, F.col("n").cast("long").alias("n"), F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / F.when(most != expected, most - expected)).alias("ari"))


def quantile_bins(df: DataFrame, c: str, k: int, out: str) -> DataFrame:
    """Right-closed bins of equal mass by whole-series quantiles; ties stay together, bins number from 0."""
    df = df.withColumn("_cuts", F.percentile(c, F.array(*[F.lit(j / k) for j in range(1, k)])).over(whole()))
    over = [(F.col(c) > F.get("_cuts", F.lit(j))).cast("int") for j in range(k - 1)]
    return df.withColumn(out, sum(over[1:], over[0])).drop("_cuts")


def proxies(df: DataFrame, *, price: str = "close", vix: str = "vix") -> DataFrame:
    """The four proxy labels: vix quartile, drawdown tercile, vix over 30 (null with under 5 such days), 50-row mean over the 200-row one."""
    df = market_proxies(df, price=price)
    df = df.withColumn("drawdown_252", F.when(F.count(price).over(rows(252)) == 252, F.col("drawdown_252")))
    df = quantile_bins(quantile_bins(df, vix, 4, "vix_quartile"), "drawdown_252", 3, "drawdown_tercile")
    high = (F.col(vix) > 30).cast("int")
    return df.withColumn("vix_crisis", F.when(F.sum(high).over(whole()) >= 5, high)).withColumnRenamed("sma_cross", "sma_trend")


def alignment(df: DataFrame, label: str = "regime", names: tuple[str, ...] = ("vix_quartile", "drawdown_tercile", "vix_crisis", "sma_trend")) -> DataFrame:
    """(series_id, proxy, ari, score): the best agreement with a proxy times 25, none below 0 (score repeats on each row)."""
    long = df.select("series_id", label, F.explode(F.array(*[F.struct(F.lit(n).alias("proxy"), F.col(n).cast("int").alias("value")) for n in names])).alias("p")).select("series_id", label, "p.*")
    found = adjusted_rand(long, label, "value", keys=("series_id", "proxy"))
    return found.withColumn("score", 25 * F.greatest(F.max("ari").over(whole()), F.lit(0.0)))


def walk_forward(df: DataFrame, *, regime: str = "regime", ret: str = "ret", safe: str = "safe_ret", train: int = 252, refit: int = 21, mode: str = "rubric") -> DataFrame:
    """(series_id, n, sharpe, benchmark, score): long the risky series in regimes whose mean return so far is positive, the safe one in
    others, and in those not seen yet; annualised Sharpe ratios and 25 points by their difference."""
    df = regime_mean(df, regime, ret, train=train, refit=refit, out="_mean").filter(F.col("i") > train)
    held = F.when(F.col("_mean") > 0, F.col(ret)).otherwise(F.coalesce(F.col(safe), F.lit(0.0)))
    df = df.withColumn("_held", held)
    sharpe = lambda c: F.coalesce(F.avg(c) / F.when(F.stddev_samp(c) > 0, F.stddev_samp(c)) * F.sqrt(F.lit(252.0)), F.lit(0.0))
    out = df.groupBy("series_id").agg(F.count("*").alias("n"), sharpe("_held").alias("sharpe"), sharpe(ret).alias("benchmark"))
    gain = F.col("sharpe") - F.col("benchmark")
    score = _linear(gain, [(-0.1, 0.0), (0.0, 5.0), (0.2, 15.0), (0.5, 25.0)])
    if mode == "plan":
        score = F.when((F.col("benchmark") < 0) & (F.col("sharpe") < 0), F.greatest(score, F.lit(5.0))).otherwise(score)
    return out.withColumn("score", score)


def spike_events(df: DataFrame, c: str = "vix", *, n: int = 252, merge: int = 5) -> DataFrame:
    """(series_id, event, event_ts, event_i): rows over the trailing mean + 2 deviations; spikes within ``merge`` rows are one event, dated
    by its first."""
    w = rows(n)
    hot = df.withColumn("_hot", (F.count(c).over(w) >= n) & (F.col(c) > F.avg(c).over(w) + 2 * F.stddev_samp(c).over(w))).filter("_hot")
    gap = F.col("i") - F.lag("i").over(ordered())
    hot = hot.withColumn("_new", F.when(gap.isNull() | (gap > merge), 1).otherwise(0)).withColumn("event", F.sum("_new").over(ordered().rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return hot.groupBy("series_id", "event").agg(F.min("ts").alias("event_ts"), F.min("i").alias("event_i"))


def event_response(events: DataFrame, changes: DataFrame, *, before: int = 5, after: int = 10) -> DataFrame:
    """(series_id, event, event_ts, lag_days, score): the nearest regime change from 5 days before to 10 after each event; 1 - |lag| / 10.

    changes: (series_id, ts). The range is turned into an equi-join on the days of the event's reach."""
    reach = events.withColumn("_day", F.explode(F.sequence(F.date_sub("event_ts", before), F.date_add("event_ts", after))))
    marks = changes.select(F.col("series_id").alias("_s"), F.col("ts").alias("_ts")).distinct()
    met = reach.join(marks, (F.col("series_id") == F.col("_s")) & (F.col("_day") == F.col("_ts")), "left")
    lag = F.datediff("_ts", "event_ts")
    out = met.groupBy("series_id", "event", "event_ts").agg(F.min(F.when(F.col("_ts").isNotNull(), F.struct(F.abs(lag).alias("d"), lag.alias("lag")))).alias("x"))
    return out.select("series_id", "event", "event_ts", F.col("x.lag").alias("lag_days"), F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(F.col("x.lag")) / after), F.lit(0.0)).alias("score"))


def responsiveness(responses: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, events, mean_response, score): ten times the mean response; a series without events has all 10 points."""
    found = responses.groupBy("series_id").agg(F.count("*").alias("events"), F.avg("score").alias("mean_response"))
    return series.select("series_id").distinct().join(found, "series_id", "left").select("series_id", F.coalesce("events", F.lit(0)).alias("events"), "mean_response", F.coalesce(10 * F.col("mean_response"), F.lit(10.0)).alias("score"))


def grade(total: Column) -> Column:
    return F.when(total >= 85, "A").when(total >= 70, "B").when(total >= 55, "C").when(total >= 40, "D").otherwise("F")


def composite(scores: DataFrame, *, days: str = "n_days") -> DataFrame:
    """Total and grade of a row of the five scores; with under 252 days walk_forward is left out and the rest scaled to 100."""
    parts = ("separability", "stability", "alignment", "walk_forward", "responsiveness")
    full = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    rest = full - F.col("walk_forward")
    total = F.when(F.col(days) < 252, rest * (100 / 75)).otherwise(full)
    return scores.withColumn("total", F.round(total, 4)).withColumn("grade", grade(F.col("total")))


def metric_rows(scores: DataFrame, algorithm: str) -> DataFrame:
    """Every intermediate value as one row: (algorithm, series_id, metric, value)."""
    numbers = [c for c, t in scores.dtypes if t in ("double", "bigint", "int")]
    return scores.select(F.lit(algorithm).alias("algorithm"), "series_id", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])).alias("m")).select("algorithm", "series_id", "m.*")
