"""Six detectors: series in; series_id, i, ts, close, score columns, regime, label, confidence and transition_flag out.

``causal`` tells whether a row's regime depends on later rows (it does wherever clusters or whole-series quantiles are fitted).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering, kernels, labels, paths, segments, thresholds, windows
from ..series import ordered, settled, whole


@dataclass(frozen=True)
class EnsembleZscore:
    """Sliding signatures, multi-lag discrepancy, trailing mean + k deviations; regimes by linkage of mean signatures."""

    window: int = 21
    ensemble: int = 12
    lags: dict = field(default_factory=lambda: {4: 0.5, 8: 0.3, 12: 0.2})
    sigma: float = 1.0
    history: int = 504
    regimes: int = 4
    causal = False


@dataclass(frozen=True)
class SegmentKmeans:
    """Power signatures every few rows, linear reference/test discrepancy, median + MAD with a ladder; segments clustered by their statistics."""

    window: int = 21
    stride: int = 5
    depth: int = 4
    reference: int = 10
    test: int = 10
    regimes: int = 3
    causal = False


@dataclass(frozen=True)
class FeatureKmeans:
    """k-means of 20-row return and volatility, ranked by return, short runs merged."""

    window: int = 20
    regimes: int = 3
    shortest: int = 5
    causal = False


@dataclass(frozen=True)
class SignatureVote:
    """k-means of daily signature features of the window before the day, then a majority vote."""

    window: int = 20
    regimes: int = 3
    vote: int = 21
    causal = False


@dataclass(frozen=True)
class GammaMerge:
    """Area features of disjoint blocks, mean discrepancy at lags 1 and 2, gamma threshold; short regimes merged and clustered."""

    window: int = 10
    ensemble: int = 4
    lags: dict = field(default_factory=lambda: {1: 0.5, 2: 0.5})
    q: float = 0.95
    shortest: int = 15
    regimes: int = 4
    causal = False


@dataclass(frozen=True)
class MomentWindow:
    """Rolling moments, daily reference/test discrepancy with its own bandwidth, sustained expanding z; regimes clustered by their means."""

    reference: int = 40
    test: int = 20
    start: int = 60
    regimes: int = 3
    causal = False


def _finish(df: DataFrame, regime: str = "regime") -> DataFrame:
    return windows.change_flag(segments.relabeled(df, regime, "regime"), "regime")


def _named(df: DataFrame, naming) -> DataFrame:
    df = settled(df)
    stats = naming(labels.profile(df)).select(F.col("series_id").alias("_s"), F.col("regime").alias("_r"), "label")
    return df.join(stats, (F.col("series_id") == F.col("_s")) & (F.col("regime") == F.col("_r")), "left").drop("_s", "_r")


def ensemble_zscore(df: DataFrame, config: EnsembleZscore = EnsembleZscore()) -> DataFrame:
    c = config
    df = paths.scaled_path(windows.log_return(df))
    sig = paths.iterated_sums(df, c.window)
    names = ["s_t", "s_x", "s_tt", "s_tx", "s_xt", "s_xx"]
    sig = paths.standardized(sig, names).withColumn("sig", F.when(F.col("i") >= c.window, F.array(F.lit(1.0), *names)))
    scores = kernels.lag_scores(sig, "sig", c.ensemble, c.lags, sigma=c.sigma)
    # an ensemble that starts at sub-path e ends at row e + ensemble - 1: its score is dated there
    dated = scores.select("series_id", (F.col("i") + c.ensemble - 1).cast("int").alias("i"), "score")
    base = df.select("series_id", "i", "ts", "close", "ret").join(dated, ["series_id", "i"], "left")
    flagged = settled(thresholds.rolling_z(base, n=c.history))
    means = paths.ensemble_mean(sig, names, c.ensemble).withColumn("mean_sig", F.when(F.col("mean_s_xx").isNotNull(), F.array(*[f"mean_{n}" for n in names]))).select("series_id", "i", "mean_sig")
    labeled = clustering.ward_regimes(flagged.join(means, ["series_id", "i"], "left"), "mean_sig", c.regimes).drop("mean_sig")
    labeled = labels.score_confidence(_finish(labeled.withColumn("regime", F.coalesce("regime", F.lit(0)))))
    return _named(labeled, labels.name_by_volatility)


def segment_kmeans(df: DataFrame, config: SegmentKmeans = SegmentKmeans()) -> DataFrame:
    c = config
    df = windows.log_return(df, first="zero")
    sig = paths.power_signature(df, c.window, "ret", c.depth, c.stride).withColumn("end_i", F.col("i")).withColumn("i", ((F.col("i") - c.window) / c.stride + 1).cast("int"))
    names = [f"sig_{k}" for k in range(1, c.depth + 1)]
    scored = kernels.reference_scores(paths.standardized(sig, names), names, c.reference, c.test).filter("score is not null and i % 2 = 0")
    ranked = settled(scored).withColumn("at", F.col("end_i")).withColumn("i", F.row_number().over(ordered()).cast("int")).select("series_id", "i", "at", "score")
    changed = thresholds.ladder_mad(ranked).filter("is_change").select("series_id", (F.col("at") - 1).alias("cp"))
    days = settled(segments.numbered(segments.from_change_days(df, changed, out="_run"), "_run"))
    stats = segments.segment_stats(days.withColumn("regime", F.col("seg"))).withColumn("vol", F.coalesce("vol", F.lit(0.0))).withColumn("sharpe", F.col("mean_ret") / (F.col("vol") + 1e-12)).withColumn("i", F.col("seg"))
    fitted = clustering.kmeans(stats, ["mean_ret", "vol", "sharpe", "max_dd"], c.regimes, out="regime").select("series_id", "seg", F.col("regime").alias("_c"), "d_own", "d_other")
    out = days.drop("regime").join(fitted, ["series_id", "seg"], "left").withColumn("regime", F.coalesce("_c", F.lit(0)))
    out = labels.ratio_confidence(out, "d_own", "d_other").drop("_run", "_c", "d_own", "d_other")
    return _named(_finish(out), labels.name_by_return)


def feature_kmeans(df: DataFrame, config: FeatureKmeans = FeatureKmeans()) -> DataFrame:
    c = config
    df = windows.log_return(df)
    df = windows.rolling_std(windows.log_return(df, c.window, out="ret_n"), "ret", c.window, "vol_n", annual=True)
    fitted = clustering.kmeans(df, ["ret_n", "vol_n"], c.regimes).select("series_id", "i", F.col("regime").alias("_r"), "d_own")
    out = settled(df.join(fitted, ["series_id", "i"], "left"))
    first = F.first("_r", ignorenulls=True).over(whole().orderBy("i").rowsBetween(0, 10**9))
    out = out.withColumn("regime", F.coalesce("_r", first, F.lit(0)))
    ranks = labels.name_by_return(labels.profile(out)).select(F.col("series_id").alias("_s"), F.col("regime").alias("_o"), (F.col("rank") - 1).alias("_rank"))
    out = out.join(ranks, (F.col("series_id") == F.col("_s")) & (F.col("regime") == F.col("_o"))).withColumn("regime", F.col("_rank").cast("int")).drop("_s", "_o", "_rank", "_r")
    out = segments.merged(settled(out), policy="neighbor", limit=c.shortest)
    out = labels.percentile_confidence(out, "d_own").withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).drop("d_own")
    return _named(_finish(out), labels.name_by_return)


def signature_vote(df: DataFrame, config: SignatureVote = SignatureVote()) -> DataFrame:
    c = config
    df = paths.scaled_path(windows.log_return(df, first="guard").withColumn("ret", F.coalesce("ret", F.lit(0.0))))
    features = paths.daily_outer(df, c.window)
    names = [n for n in features.columns if n.startswith("o_")]
    fitted = clustering.kmeans(features, names, c.regimes, scale=False).select("series_id", "i", F.col("regime").alias("_r"), "d_own")
    out = df.join(fitted, ["series_id", "i"], "left").withColumn("_r", F.coalesce("_r", F.lit(0)))
    out = settled(windows.majority_vote(out, "_r", list(range(c.regimes)), c.vote, "regime").drop("_r"))
    return _named(_finish(labels.nearest_confidence(out, "d_own").drop("d_own")), labels.name_by_return)


def gamma_merge(df: DataFrame, config: GammaMerge = GammaMerge()) -> DataFrame:
    c = config
    df = windows.simple_return(paths.transformed_path(df, "close", ("time", "state"))).withColumn("t", F.col("t") * 1.0)
    blocks = paths.area_features(df, c.window).withColumn("i", F.col("block") + 1)
    names = ["delta_x", "area_x"]
    vectors = paths.standardized(blocks, names).withColumn("v", F.array(*names))
    scores = kernels.lag_scores(vectors, "v", c.ensemble, c.lags, sigma=1.0, mode="sqrt")
    flagged = thresholds.gamma_limit(scores.withColumn("i", F.col("i").cast("int")), q=c.q)
    changes = flagged.filter("is_change").select("series_id", (F.col("i") + c.ensemble - 1).alias("cp"))
    out = settled(segments.from_change_days(df, changes, step=c.window))
    out = settled(segments.merged(out, policy="regime", limit=c.shortest).withColumn("_v", F.col("ret") * F.col("ret")))
    out = clustering.cluster_regimes(out, ["ret", "_v"], c.regimes, at_least=1).withColumn("regime", F.col("cluster")).drop("cluster", "_v")
    out = segments.numbered(_finish(out))
    return _named(labels.edge_confidence(out), labels.name_by_rank)


def moment_window(df: DataFrame, config: MomentWindow = MomentWindow()) -> DataFrame:
    c = config
    df = windows.moment_features(df, spans=(5, 20))
    names = ["mean_5", "std_5", "mean_20", "std_20", "up_20", "dd_20"]
    scaled = paths.standardized(df, names, first=c.start + 20)
    scored = kernels.window_scores(scaled, names, c.reference, c.test).select("series_id", "i", "score")
    out = df.select("series_id", "i", "ts", "close", "ret", *names).join(scored, ["series_id", "i"], "left")
    out = segments.from_changes(thresholds.two_pass(settled(out), start=c.start))
    out = settled(thresholds.forced_split(out))
    out = clustering.cluster_regimes(out, names, c.regimes).withColumn("regime", F.col("cluster")).drop("cluster")
    out = out.withColumn("threshold", F.percentile("score", 0.88).over(whole()))
    out = labels.threshold_confidence(out).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
    return _named(_finish(out.drop(*names)), labels.name_by_risk)


PRESETS = {"ensemble_zscore": ensemble_zscore, "segment_kmeans": segment_kmeans, "feature_kmeans": feature_kmeans, "signature_vote": signature_vote, "gamma_merge": gamma_merge, "moment_window": moment_window}


def run(name: str, df: DataFrame) -> DataFrame:
    """A preset's rows for a canonical series table of any number of series."""
    return PRESETS[name](df)
