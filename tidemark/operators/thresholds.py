"""Adaptive thresholds and change detection on score series (series_id, i, score; null means undefined).

Rules that look at whole-series quantiles or pick from a ladder look ahead; the trailing ones do not. Rules whose
decisions feed their own state run as an ordered fold for each series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import gamma_ppf
from ..series import ordered, whole
from .windows import ema, expanding_z, median_mad, quantile_threshold, sustained, trailing_moments, z_threshold


def percentile_flag(df: DataFrame, q: float, *, c: str = "score", out: str = "is_change", above: str = "gt") -> DataFrame:
    limit = F.percentile(c, q).over(whole())
    flag = F.col(c) > limit if above == "gt" else F.col(c) >= limit
    return df.withColumn("threshold", limit).withColumn(out, F.coalesce(flag, F.lit(False)))


def spaced(df: DataFrame, flag: str, width: int, *, out: str = "is_change") -> DataFrame:
    """Greedy suppression: after a kept hit, hits fewer than ``width`` rows later are dropped.

    One ordered pass over each series, whose state is the last kept hit."""
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("i").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        i = table.column("i").to_numpy()
        kept = np.zeros(len(i), bool)
        last = None
        for k in np.nonzero(table.column(flag).fill_null(False).to_numpy(zero_copy_only=False))[0]:
            if last is None or i[k] - last >= width:
                kept[k], last = True, i[k]
        return table.append_column(out, pa.array(kept))

    df = df.drop(out) if out != flag else df.withColumnRenamed(out, "_flag")
    if out == flag:
        return spaced(df, "_flag", width, out=out).drop("_flag")
    return df.groupBy("series_id").applyInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` boolean")


def spaced_hits(df: DataFrame, flag: str, width: int) -> DataFrame:
    """(series_id, i) of the kept hits, by a fold over the array of hits: for few hits in long series."""
    hits = F.array_sort(F.collect_list(F.when(F.col(flag), F.col("i"))))
    kept = F.aggregate(F.col("_hits"), F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("kept")),
                       lambda acc, i: F.when(acc["last"].isNull() | (i - acc["last"] >= width), F.struct(i.alias("last"), F.concat(acc["kept"], F.array(i)).alias("kept"))).otherwise(acc))["kept"]
    return df.groupBy("series_id").agg(hits.alias("_hits")).select("series_id", F.explode(kept).alias("i"))


def rolling_z(df: DataFrame, *, n: int = 504, ks: tuple[float, ...] = (2.5, 3.0, 3.5, 4.0, 4.5, 5.0), most: float = 0.2, c: str = "score") -> DataFrame:
    """Mean + k deviations over the trailing rows, k the first of ``ks`` at which at most ``most`` of the known scores exceed it."""
    df = z_threshold(df, c, n=n, k=0.0, out="_mean")
    w = ordered().rowsBetween(-(n - 1), 0)
    df = df.withColumn("_sd", F.when(F.col("_mean").isNotNull(), F.stddev_pop(c).over(w)))
    limits = [F.when(F.col("_sd") < 1e-12, F.col("_mean")).otherwise(F.col("_mean") + k * F.col("_sd")) for k in ks]
    shares = [F.sum((F.col(c) > limit).cast("int")).over(whole()) / F.count(c).over(whole()) for limit in limits]
    df = df.withColumn("k", F.coalesce(*[F.when(s <= most, F.lit(k)) for s, k in zip(shares, ks)], F.lit(ks[-1])))
    limit = F.when(F.col("_sd") < 1e-12, F.col("_mean")).otherwise(F.col("_mean") + F.col("k") * F.col("_sd"))
    return df.withColumn("threshold", limit).withColumn("is_change", F.coalesce(F.col(c) > F.col("threshold"), F.lit(False))).drop("_mean", "_sd")


def feedback_percentile(df: DataFrame, *, q: float = 0.95, memory: int = 200, at_least: int = 50, c: str = "score") -> DataFrame:
    """Quantile of the last ``memory`` scores that were themselves no changes; the decision feeds the memory, so it is a fold."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        calm: list[float] = []
        limits, flags = [], []
        for s in rows[c]:
            limit = float(np.quantile(calm[-memory:], q)) if len(calm) >= max(20, at_least) else np.nan
            change = bool(s == s and limit == limit and s > limit)
            if s == s and not change:
                calm.append(float(s))
            limits.append(limit)
            flags.append(change)
        return rows.assign(threshold=limits, is_change=flags)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", threshold double, is_change boolean"
    return df.groupBy("series_id").applyInPandas(run, schema).withColumn("threshold", F.when(~F.isnan("threshold"), F.col("threshold")))


def gamma_limit(df: DataFrame, *, q: float = 0.95, back: int = 100, c: str = "score") -> DataFrame:
    """Quantile of the gamma distribution with the trailing mean and variance; the trailing quantile where fewer than five
    scores are known or they do not vary. No flag at all falls back to the 95th percentile, over 30 % to the 99th."""
    df = trailing_moments(df, c, back)
    w = ordered().rowsBetween(-back, 0)
    usable = (F.col("known") >= 5) & (F.col("mean") > 0) & (F.col("var") > 1e-18)
    fitted = gamma_ppf(F.lit(q), F.when(usable, F.col("mean") * F.col("mean") / F.col("var")), F.when(usable, F.col("var") / F.col("mean")))
    df = df.withColumn("_fit", fitted).withColumn("threshold", F.when(usable & ~F.isnan("_fit"), F.col("_fit")).otherwise(F.coalesce(F.percentile(c, q).over(w), F.lit(1e-6))))
    over = F.coalesce(F.col(c) > F.col("threshold"), F.lit(False))
    share = F.avg(over.cast("int")).over(whole())
    df = df.withColumn("threshold", F.when(share == 0, F.percentile(c, 0.95).over(whole())).when(share > 0.3, F.percentile(c, 0.99).over(whole())).otherwise(F.col("threshold")))
    return df.withColumn("is_change", F.coalesce(F.col(c) > F.col("threshold"), F.lit(False))).drop("_fit", "mean", "var", "known")


def median_mad_limit(df: DataFrame, *, n: int = 51, k: float = 1.5, floor: float = 0.6, width: int = 15, c: str = "score") -> DataFrame:
    """The larger of centred median + k 1.4826 MAD and a whole-series percentile, then greedy suppression (looks ahead)."""
    df = median_mad(df, c, n)
    df = df.withColumn("threshold", F.greatest(F.col("median") + k * 1.4826 * F.col("mad"), F.percentile(c, floor).over(whole())))
    df = df.withColumn("_over", F.coalesce(F.col(c) > F.col("threshold"), F.lit(False)))
    return spaced(df, "_over", width).drop("_over", "median", "mad")


def ladder_quantile(df: DataFrame, *, alphas: tuple[float, ...] = (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.6, 0.5), gap: int = 10, least: int = 2, most: int = 100, c: str = "score") -> DataFrame:
    """Trailing quantile of the first ``alpha`` that leaves ``least`` to ``most`` spaced flags in the series; none: the 70th percentile."""
    kept = df
    for j, a in enumerate(alphas):
        kept = quantile_threshold(kept, c, q=a, out=f"_t{j}").withColumn("_over", F.coalesce(F.col(c) > F.col(f"_t{j}"), F.lit(False)))
        kept = spaced(kept, "_over", gap, out=f"_f{j}")
    limit = F.percentile(c, 0.7).over(whole())
    kept = kept.withColumn("_tz", limit).withColumn("_over", F.coalesce(F.col(c) > F.col("_tz"), F.lit(False)))
    kept = spaced(kept, "_over", gap, out="_fz")
    n = {j: F.sum(F.col(f"_f{j}").cast("int")).over(whole()) for j in range(len(alphas))}
    chosen = F.coalesce(*[F.when(n[j].between(least, most), F.lit(j)) for j in n], F.lit(-1))
    kept = kept.withColumn("_j", chosen)
    pick = lambda p: F.coalesce(*[F.when(F.col("_j") == j, F.col(f"{p}{j}")) for j in n], F.when(F.col("_j") == -1, F.col(f"{p}z")))
    kept = kept.withColumn("threshold", pick("_t")).withColumn("is_change", F.coalesce(pick("_f"), F.lit(False)))
    return kept.select(*df.columns, "threshold", "is_change")


def ladder_mad(df: DataFrame, *, steps: tuple[tuple[float, float], ...] = ((1.5, 0.6), (1.0, 0.55), (0.5, 0.5), (0.3, 0.45)), least: int = 3, n: int = 51, width: int = 15, c: str = "score") -> DataFrame:
    """The first (k, floor) step that leaves at least ``least`` changes; else the third; and if that has none, the largest score alone."""
    out = df
    for j, (k, floor) in enumerate(steps):
        out = median_mad_limit(out, n=n, k=k, floor=floor, width=width, c=c).withColumnsRenamed({"threshold": f"_t{j}", "is_change": f"_f{j}"})
    counts = [F.sum(F.col(f"_f{j}").cast("int")).over(whole()) for j in range(len(steps))]
    fallback = min(2, len(steps) - 1)
    out = out.withColumn("_j", F.coalesce(*[F.when(x >= least, F.lit(j)) for j, x in enumerate(counts)], F.lit(fallback)))
    pick = lambda p: F.coalesce(*[F.when(F.col("_j") == j, F.col(f"{p}{j}")) for j in range(len(steps))])
    best = F.max_by("i", c).over(whole())
    out = out.withColumn("threshold", pick("_t")).withColumn("_f", F.coalesce(pick("_f"), F.lit(False)))
    none = F.sum(F.col("_f").cast("int")).over(whole()) == 0
    return out.withColumn("is_change", F.col("_f") | (none & (F.col("i") == best))).select(*df.columns, "threshold", "is_change")


def ema_flag(df: DataFrame, *, threshold: str, factor: float = 1.5, n: int = 3, at_least: int = 2, c: str = "score") -> DataFrame:
    """Scores over ``factor`` times their exponential mean and over the threshold, in at_least of n rows."""
    df = ema(df, c, 0.1, "_ema").withColumn("_f", F.coalesce((F.col(c) > factor * F.col("_ema")) & (F.col(c) > F.col(threshold)), F.lit(False)))
    return sustained(df, "_f", n, at_least, "_s").withColumn("is_change", F.col("_s") == 1).drop("_ema", "_f", "_s")


def expanding_z_flag(df: DataFrame, *, q: float = 0.88, run: int = 3, start: int = 60, c: str = "score") -> DataFrame:
    """Expanding z-scores over their whole-series percentile (looks ahead), ``run`` rows in a row, none before ``start``; with under 30
    scores the percentile of the scores themselves."""
    df = expanding_z(df, c, "_z").withColumn("_z", F.when(F.col("i") < start, 0.0).otherwise(F.col("_z")))
    few = F.count(c).over(whole()) < 30
    flag = F.when(few, F.col(c) > F.percentile(c, q).over(whole())).otherwise(F.col("_z") > F.percentile("_z", q).over(whole()))
    df = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    return sustained(df, "_f", run, run, "_s").withColumn("is_change", F.col("_s") == 1).drop("_z", "_f", "_s")


def two_pass(df: DataFrame, *, first: tuple[float, int] = (0.88, 3), low: tuple[float, int] = (0.75, 2), high: tuple[float, int] = (0.92, 4), limits: tuple[int, int] = (2, 40), c: str = "score", start: int = 60) -> DataFrame:
    """expanding_z_flag; without any flag again with ``low``, with too many again with ``high`` if that then fits the limits."""
    base = expanding_z_flag(df, q=first[0], run=first[1], start=start, c=c).withColumnRenamed("is_change", "_a")
    base = expanding_z_flag(base, q=low[0], run=low[1], start=start, c=c).withColumnRenamed("is_change", "_b")
    base = expanding_z_flag(base, q=high[0], run=high[1], start=start, c=c).withColumnRenamed("is_change", "_c")
    n = {x: F.sum(F.col(x).cast("int")).over(whole()) for x in ("_a", "_c")}
    chosen = F.when(n["_a"] == 0, F.col("_b")).when((n["_a"] > limits[1]) & n["_c"].between(*limits), F.col("_c")).otherwise(F.col("_a"))
    return base.withColumn("is_change", chosen).drop("_a", "_b", "_c")


def _mmd(k: np.ndarray, left: np.ndarray, right: np.ndarray) -> float:
    n, m = len(left), len(right)
    if n < 2 or m < 2:
        return 0.0
    xx, yy, xy = k[np.ix_(left, left)], k[np.ix_(right, right)], k[np.ix_(left, right)]
    return float((xx.sum() - np.trace(xx)) / (n * (n - 1)) + (yy.sum() - np.trace(yy)) / (m * (m - 1)) - 2 * xy.mean())


def permutation_test(df: DataFrame, vector: str, side: str, group: str, *, sigma: float = 1.0, draws: int = 100, q: float = 0.95, seed: int = 42) -> DataFrame:
    """(group, stat, threshold, p_value): the discrepancy of the two sides of a group (side true and false) against random splits of
    the same sizes, ``draws`` of them. For windows: a group is held by one task."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("_i")["v"].to_numpy())
        s = rows.sort_values("_i")["s"].to_numpy(bool)
        k = np.exp(-np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0) / (2 * sigma * sigma))
        rng = np.random.default_rng(seed)
        stat = _mmd(k, np.nonzero(s)[0], np.nonzero(~s)[0])
        drawn = np.array([_mmd(k, p[:s.sum()], p[s.sum():]) for p in (rng.permutation(len(x)) for _ in range(draws))])
        return pd.DataFrame({"g": [rows["g"].iloc[0]], "stat": [stat], "threshold": [float(np.quantile(drawn, q))], "p_value": [float((1 + (drawn >= stat).sum()) / (1 + draws))]})

    base = df.select(F.col(group).cast("string").alias("g"), F.col(side).alias("s"), F.col(vector).cast("array<double>").alias("v"), F.col("i").alias("_i"))
    return base.groupBy("g").applyInPandas(run, "g string, stat double, threshold double, p_value double").withColumnRenamed("g", group)


def bootstrap_limit(df: DataFrame, vector: str, group: str, *, size: int = 10, draws: int = 200, q: float = 0.95, gamma: float = 1.0, seed: int = 42) -> DataFrame:
    """(group, threshold): quantile of the discrepancy between two random samples of ``size`` from the same group, without
    replacement where it has 2 size members."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("_i")["v"].to_numpy())
        k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
        rng = np.random.default_rng(seed)
        s = min(size, max(1, len(x) // 2)) if len(x) < 2 * size else size
        picks = (rng.choice(len(x), 2 * s, replace=len(x) < 2 * s) for _ in range(draws))
        drawn = [max(0.0, _mmd(k, p[:s], p[s:])) for p in picks]
        return pd.DataFrame({"g": [rows["g"].iloc[0]], "threshold": [float(np.quantile(drawn, q))]})

    base = df.select(F.col(group).cast("string").alias("g"), F.col(vector).cast("array<double>").alias("v"), F.col("i").alias("_i"))
    return base.groupBy("g").applyInPandas(run, "g string, threshold double").withColumnRenamed("g", group)


def forced_split(df: DataFrame, regime: str = "regime", c: str = "score", *, out: str = "regime") -> DataFrame:
    """Where a series has one regime only, the rows from its largest score on become a second one."""
    at = F.max_by("i", F.struct(F.col(c), -F.col("i"))).over(whole())
    single = F.min(regime).over(whole()) == F.max(regime).over(whole())
    return df.withColumn(out, F.when(single & (F.col("i") >= at), F.col(regime) + 1).otherwise(F.col(regime)))
