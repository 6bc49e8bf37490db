"""Registered queries over the driver's tables, each with the SQL that must give the same rows where SQL can.

Prices are those of ``series.segment_px`` (one series a market segment) or ``orders_px``. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clustering, contract, evaluate, kernels, labels, paths, segments, thresholds, windows
from ..series import events_px, orders_px, segment_px, table, whole
from ..sources import readers, synthetic
from . import presets

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def tidy(df: DataFrame, *exact: str, digits: int = 6, **rounded: Column | str) -> DataFrame:
    """The named columns as they are, the others rounded, no negative zero and no NaN."""
    out = []
    for name, c in rounded.items():
        c = F.col(c) if isinstance(c, str) else c
        r = F.round(c, digits)
        out.append(F.when(r == 0, 0.0).when(~F.isnan(r), r).alias(name))
    return df.select(*exact, *out)


def r(x: str, digits: int = 6) -> str:
    return f"CASE WHEN round({x}, {digits}) = 0 THEN 0.0 ELSE round({x}, {digits}) END"


# ---- SQL building blocks -------------------------------------------------------------------------------------------
_DAY = "CAST(o_orderdate AS DATE)"
SEG = f"""px AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM (SELECT c_mktsegment AS series_id, {_DAY} AS ts, avg(o_totalprice) AS close, count(*) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))"""
ONE = f"""px AS (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM (SELECT 'orders' AS series_id, {_DAY} AS ts, avg(o_totalprice) AS close, count(*) AS volume FROM orders GROUP BY 2))"""
W = "PARTITION BY series_id ORDER BY i"
RET = f"rt AS (SELECT *, ln(close / lag(close) OVER ({W})) AS ret FROM px)"


def fr(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, c: str, n: int, at_least: int | None = None) -> str:
    return f"CASE WHEN count({c}) OVER {fr(n)} >= {n if at_least is None else at_least} THEN {agg} OVER {fr(n)} END"


WALL = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
VOL = f"v AS (SELECT *, {full('stddev_samp(ret)', 'ret', 20)} * sqrt(252.0) AS vol0 FROM rt), v2 AS (SELECT *, coalesce(vol0, first_value(vol0 IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vol FROM v)"
CUT = "q AS (SELECT series_id, quantile_cont(vol, 1/3.0) AS c1, quantile_cont(vol, 2/3.0) AS c2, min(vol) AS lo, max(vol) AS hi FROM v2 GROUP BY 1)"
REG = "g AS (SELECT v2.*, (CASE WHEN vol > c1 THEN 1 ELSE 0 END) + (CASE WHEN vol > c2 THEN 1 ELSE 0 END) AS regime, CASE WHEN hi > lo THEN least(1.0, 0.5 + least(abs(vol - c1), abs(vol - c2)) / (hi - lo)) ELSE 0.5 END AS confidence FROM v2 JOIN q USING (series_id))"
REGIME = f"{SEG}, {RET}, {VOL}, {CUT}, {REG}"


def regimes(s: SparkSession, d: str) -> DataFrame:
    """The tercile regimes that the label queries work on."""
    return clustering.tercile_regimes(windows.log_return(segment_px(s, d)))


# ---- series, filters, projections ----------------------------------------------------------------------------------
@register(f"WITH {SEG} SELECT series_id, ts, i, {r('close', 4)} AS close, volume FROM px")
def daily_series(s, d):
    return tidy(segment_px(s, d), "series_id", "ts", "i", "volume", close="close", digits=4)


@register(f"WITH {ONE} SELECT series_id, ts, i, {r('close', 4)} AS close, volume FROM px WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def window_filter(s, d):
    return tidy(orders_px(s, d).filter(F.col("ts").between("1996-01-01", "1997-12-31")), "series_id", "ts", "i", "volume", close="close", digits=4)


@register(f"WITH {SEG}, {RET} SELECT series_id, i, {r('sum(ret) OVER ' + fr(20))} AS ret_20 FROM rt WHERE ts >= DATE '1996-01-01' - 400 QUALIFY ts >= DATE '1996-01-01'")
def lookback_filter(s, d):
    df = windows.log_return(segment_px(s, d)).filter(F.col("ts") >= F.date_sub(F.lit("1996-01-01").cast("date"), 400))
    return tidy(windows.rolling_sum(df, "ret", 20, "ret_20").filter(F.col("ts") >= F.lit("1996-01-01").cast("date")), "series_id", "i", ret_20="ret_20")


@register("SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) AS i, " + r("avg(value)", 6) + " AS close, count(*) AS volume FROM events GROUP BY 1, 2")
def hourly_events(s, d):
    return tidy(events_px(s, d), "series_id", "ts", "i", "volume", close="close")


@register(f"WITH {SEG}, n AS (SELECT series_id, count(*) AS n FROM px GROUP BY 1 HAVING count(*) >= 100 ORDER BY n DESC, series_id LIMIT 3) SELECT px.series_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM px JOIN n USING (series_id) GROUP BY 1")
def longest_series(s, d):
    return readers.most_rows(segment_px(s, d), 3, 100).groupBy("series_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@register(f"WITH {SEG} SELECT series_id, i, {r('abs(close - prev)', 4)} AS move FROM (SELECT *, lag(close) OVER ({W}) AS prev FROM px) WHERE prev IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY abs(close - prev) DESC, i) <= 5")
def top_moves(s, d):
    df = segment_px(s, d).withColumn("move", F.abs(F.col("close") - F.lag("close").over(Window.partitionBy("series_id").orderBy("i")))).dropna(subset=["move"])
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("move"), "i"))
    return tidy(df.withColumn("rank", rank).filter("rank <= 5"), "series_id", "i", move="move", digits=4)


@register(f"""WITH {SEG}, x AS (SELECT *, CASE WHEN i % 5 = 0 THEN NULL ELSE close END AS c FROM px)
SELECT series_id, i, {r("coalesce(c, 0)", 4)} AS constant, {r("coalesce(c, last_value(c IGNORE NULLS) OVER (" + W + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", 4)} AS ffill,
{r("coalesce(c, first_value(c IGNORE NULLS) OVER (" + W + " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", 4)} AS bfill, {r("greatest(100000.0, least(200000.0, coalesce(c, m)))", 4)} AS clipped FROM x JOIN (SELECT series_id, quantile_cont(c, 0.5) AS m FROM x GROUP BY 1) USING (series_id)""")
def null_filling(s, d):
    df = segment_px(s, d).withColumn("c", F.when(F.col("i") % 5 != 0, F.col("close")))
    w = Window.partitionBy("series_id").orderBy("i")
    return tidy(df.withColumn("m", F.percentile("c", 0.5).over(whole())), "series_id", "i", digits=4, constant=F.coalesce("c", F.lit(0.0)), ffill=F.last("c", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                bfill=F.first("c", True).over(w.rowsBetween(0, Window.unboundedFollowing)), clipped=F.greatest(F.lit(100000.0), F.least(F.lit(200000.0), F.coalesce("c", "m"))))


@register(f"WITH {SEG} SELECT series_id, count(*) AS n, max(gap) AS max_gap, arg_max(i, (close, -i)) AS peak_i, {r('quantile_cont(close, 0.98)', 3)} AS p98, {r('quantile_cont(close, 0.5)', 3)} AS median, {r('avg(close)', 3)} AS mean, {r('stddev_samp(close)', 3)} AS std, {r('min(close)', 3)} AS lo, {r('max(close)', 3)} AS hi FROM (SELECT *, ts - lag(ts) OVER ({W}) AS gap FROM px) GROUP BY 1")
def describe_series(s, d):
    df = segment_px(s, d).withColumn("gap", F.datediff("ts", F.lag("ts").over(Window.partitionBy("series_id").orderBy("i"))))
    out = df.groupBy("series_id").agg(F.count("*").alias("n"), F.max("gap").cast("long").alias("max_gap"), F.max_by("i", F.struct("close", -F.col("i"))).cast("long").alias("peak_i"), F.percentile("close", 0.98).alias("p98"), F.percentile("close", 0.5).alias("median"),
                                      F.avg("close").alias("mean"), F.stddev_samp("close").alias("std"), F.min("close").alias("lo"), F.max("close").alias("hi"))
    return tidy(out, "series_id", "n", "max_gap", "peak_i", p98="p98", median="median", mean="mean", std="std", lo="lo", hi="hi", digits=3)


# ---- window features -----------------------------------------------------------------------------------------------
@register(f"WITH {SEG}, {RET} SELECT series_id, i, {r('ret')} AS ret, {r('coalesce(ret, 0)')} AS ret_zero, {r('coalesce(close / lag(close) OVER (' + W + ') - 1, 0)')} AS simple, {r('ln(close / lag(close, 20) OVER (' + W + '))')} AS ret_20, {r('ln(close / lag(close, 60) OVER (' + W + '))')} AS ret_60 FROM rt")
def returns(s, d):
    df = windows.log_return(segment_px(s, d))
    df = windows.log_return(windows.simple_return(windows.log_return(df, out="ret_zero", first="zero"), out="simple"), 20, out="ret_20")
    return tidy(windows.log_return(df, 60, out="ret_60"), "series_id", "i", ret="ret", ret_zero="ret_zero", simple="simple", ret_20="ret_20", ret_60="ret_60")


@register(f"WITH {SEG}, {RET} SELECT series_id, i, {r('sum(ret) OVER ' + fr(10))} AS sum_10, {r(full('avg(ret)', 'ret', 20))} AS mean_20, {r(full('stddev_samp(ret)', 'ret', 20))} AS std_20, {r('(' + full('stddev_samp(ret)', 'ret', 60) + ') * sqrt(252.0)')} AS vol_60, {r('(' + full('stddev_samp(ret)', 'ret', 5) + ') / ((' + full('stddev_samp(ret)', 'ret', 20) + ') + 1e-10)')} AS ratio FROM rt")
def roll_sums(s, d):
    df = windows.rolling_sum(windows.log_return(segment_px(s, d)), "ret", 10, "sum_10")
    df = windows.rolling_std(windows.rolling_mean(df, "ret", 20, "mean_20"), "ret", 20, "std_20")
    df = windows.vol_ratio(windows.rolling_std(df, "ret", 60, "vol_60", annual=True), "ret", "ratio")
    return tidy(df, "series_id", "i", sum_10="sum_10", mean_20="mean_20", std_20="std_20", vol_60="vol_60", ratio="ratio")


@register(f"WITH {SEG}, {RET} SELECT series_id, i, {r(full('skewness(ret)', 'ret', 20), 5)} AS skew_20, {r(full('kurtosis(ret)', 'ret', 20), 5)} AS kurt_20, {r(full('avg(CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS INT) END)', 'ret', 20))} AS up_20 FROM rt")
def roll_moments(s, d):
    df = windows.rolling_kurt(windows.rolling_skew(windows.log_return(segment_px(s, d)), "ret", 20, "skew_20"), "ret", 20, "kurt_20")
    df = windows.up_fraction(df, "ret", 20, "up_20")
    return tidy(df, "series_id", "i", skew_20=F.round("skew_20", 5), kurt_20=F.round("kurt_20", 5), up_20="up_20")


@register(f"WITH {SEG} SELECT series_id, i, {r('(close - max(close) OVER ' + fr(20) + ') / (max(close) OVER ' + fr(20) + ' + 1e-10)')} AS dd_20, {r('(close - max(close) OVER ' + WALL + ') / max(close) OVER ' + WALL)} AS dd_all FROM px")
def drawdowns(s, d):
    return tidy(windows.running_drawdown(windows.drawdown(segment_px(s, d), 20, "dd_20"), "dd_all"), "series_id", "i", dd_20="dd_20", dd_all="dd_all")


@register(f"""WITH {SEG}, x AS (SELECT *, close - lag(close) OVER ({W}) AS dl FROM px), y AS (SELECT *, avg(CASE WHEN dl IS NOT NULL THEN greatest(dl, 0) END) OVER {fr(14)} AS g, avg(CASE WHEN dl IS NOT NULL THEN greatest(-dl, 0) END) OVER {fr(14)} AS l, count(dl) OVER {fr(14)} AS n FROM x)
SELECT series_id, i, {r('CASE WHEN n >= 7 AND l <> 0 THEN 100 - 100 / (1 + g / l) END', 5)} AS rsi FROM y""")
def rsi14(s, d):
    return tidy(windows.rsi(segment_px(s, d)), "series_id", "i", rsi="rsi", digits=5)


@register(f"WITH {SEG} SELECT series_id, i, {r('volume / (avg(volume) OVER (PARTITION BY series_id) + 1e-12)')} AS ratio, {r('volume / (avg(volume) OVER (PARTITION BY series_id, (i - 1) // 20) + 1e-12)')} AS block_ratio FROM px")
def volume_ratios(s, d):
    return tidy(windows.volume_ratio(windows.volume_ratio(segment_px(s, d), "ratio"), "block_ratio", 20), "series_id", "i", ratio="ratio", block_ratio="block_ratio")


_MED = f"({W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"


@register(f"""WITH {ONE}, m AS (SELECT *, quantile_cont(close, 0.5) OVER {_MED} AS m, count(*) OVER {_MED} AS n, (SELECT quantile_cont(close, 0.5) FROM px) AS al FROM px), k AS (SELECT *, CASE WHEN n = 21 THEN m ELSE al END AS md FROM m)
SELECT a.series_id, a.i, {r('any_value(a.md)', 5)} AS median, {r('quantile_cont(abs(b.close - a.md), 0.5)', 5)} AS mad FROM k a JOIN k b ON b.i BETWEEN a.i - 10 AND a.i + 10 GROUP BY a.series_id, a.i""")
def roll_median_mad(s, d):
    return tidy(windows.median_mad(orders_px(s, d), "close", 21), "series_id", "i", median="median", mad="mad", digits=5)


@register(f"WITH {SEG}, {RET}, z AS (SELECT *, abs(ret) AS score FROM rt) SELECT series_id, i, {r('CASE WHEN count(score) OVER ' + fr(504) + ' >= 20 THEN avg(score) OVER ' + fr(504) + ' + 3 * stddev_pop(score) OVER ' + fr(504) + ' END')} AS threshold FROM z")
def roll_z_thr(s, d):
    df = windows.log_return(segment_px(s, d)).withColumn("score", F.abs("ret"))
    return tidy(windows.z_threshold(df, "score"), "series_id", "i", threshold="threshold")


_BEF = f"({W} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)"


@register(f"WITH {SEG}, {RET}, z AS (SELECT *, CASE WHEN ret > 0 THEN ret END AS x FROM rt) SELECT series_id, i, {r('CASE WHEN count(x) OVER ' + _BEF + ' >= 10 THEN quantile_cont(x, 0.95) OVER ' + _BEF + ' END')} AS threshold FROM z")
def roll_quantile_thr(s, d):
    return tidy(windows.quantile_threshold(windows.log_return(segment_px(s, d)), "ret"), "series_id", "i", threshold="threshold")


@register(f"WITH {SEG}, {RET} SELECT series_id, i, {r('avg(ret) OVER ' + fr(101))} AS mean, {r('var_pop(ret) OVER ' + fr(101))} AS var, count(ret) OVER {fr(101)} AS known FROM rt")
def roll_gamma_moments(s, d):
    return tidy(windows.trailing_moments(windows.log_return(segment_px(s, d)), "ret"), "series_id", "i", "known", mean="mean", var="var")


@register(f"WITH {SEG}, {RET} SELECT series_id, i, {r('coalesce((ret - avg(ret) OVER ' + WALL + ') / (stddev_samp(ret) OVER ' + WALL + ' + 1e-8), 0)')} AS z FROM rt")
def zscore_expanding(s, d):
    return tidy(windows.expanding_z(windows.log_return(segment_px(s, d)), "ret"), "series_id", "i", z="z")


@register(f"""WITH RECURSIVE {ONE}, e AS (SELECT series_id, i, close AS ema FROM px WHERE i = 1 UNION ALL SELECT px.series_id, px.i, 0.1 * px.close + 0.9 * e.ema FROM e JOIN px ON px.i = e.i + 1)
SELECT series_id, i, {r('ema', 3)} AS ema FROM e""")
def ema_close(s, d):
    return tidy(windows.ema(orders_px(s, d), "close"), "series_id", "i", ema="ema", digits=3)


@register(f"WITH {REGIME}, f AS (SELECT *, CASE WHEN regime = 2 THEN 1 ELSE 0 END AS hi2 FROM g) SELECT series_id, i, CAST(sum(hi2) OVER {fr(3)} >= 3 AS INT) AS three, CAST(sum(hi2) OVER {fr(3)} >= 2 AS INT) AS two FROM f")
def sustained_signal(s, d):
    df = regimes(s, d).withColumn("hi2", F.col("regime") == 2)
    return windows.sustained(windows.sustained(df, "hi2", 3, 3, "three"), "hi2", 3, 2, "two").select("series_id", "i", "three", "two")


_V21 = f"({W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"


@register(f"""WITH {REGIME}, n AS (SELECT *, sum(CASE WHEN regime = 0 THEN 1 ELSE 0 END) OVER {_V21} AS n0, sum(CASE WHEN regime = 1 THEN 1 ELSE 0 END) OVER {_V21} AS n1, sum(CASE WHEN regime = 2 THEN 1 ELSE 0 END) OVER {_V21} AS n2 FROM g)
SELECT series_id, i, CASE greatest(n0, n1, n2) WHEN n0 THEN 0 WHEN n1 THEN 1 ELSE 2 END AS vote FROM n""")
def majority_vote(s, d):
    return windows.majority_vote(regimes(s, d), "regime", [0, 1, 2], 21, "vote").select("series_id", "i", "vote")


@register(f"""WITH {REGIME}, b AS (SELECT *, CASE WHEN i <= 252 THEN 0 ELSE (i - 253) // 21 + 1 END AS blk FROM g)
SELECT a.series_id, a.i, {r('CASE WHEN any_value(a.i) > 252 THEN avg(p.ret) END')} AS regime_mean FROM b a LEFT JOIN b p ON p.series_id = a.series_id AND p.regime = a.regime AND p.blk < a.blk AND a.i > 252 GROUP BY a.series_id, a.i""")
def regime_expanding_mean(s, d):
    return tidy(windows.regime_mean(regimes(s, d)), "series_id", "i", regime_mean="regime_mean")


@register(f"WITH {SEG} SELECT series_id, i, {r('(close - max(close) OVER ' + fr(252) + ') / (max(close) OVER ' + fr(252) + ' + 1e-10)')} AS drawdown_252, CAST(({full('avg(close)', 'close', 50)}) > ({full('avg(close)', 'close', 200)}) AS INT) AS sma_cross FROM px")
def sma_cross(s, d):
    return tidy(windows.market_proxies(segment_px(s, d)), "series_id", "i", "sma_cross", drawdown_252="drawdown_252")


@register(f"""WITH {SEG}, {RET} SELECT series_id, i, {r('(' + full('stddev_samp(ret)', 'ret', 5) + ') * sqrt(252.0)')} AS daily_vol_5d, {r('(' + full('avg(close)', 'close', 50) + ') / (' + full('avg(close)', 'close', 200) + ')')} AS sma_50_200_ratio,
{r('close / lag(close, 20) OVER (' + W + ') - 1')} AS rate_of_change_20d, {r('CASE WHEN count(volume) OVER ' + fr(20) + ' >= 20 THEN (volume - avg(volume) OVER ' + fr(20) + ') / nullif(stddev_samp(volume) OVER ' + fr(20) + ', 0) END')} AS volume_zscore_20d FROM rt""")
def contract_features(s, d):
    return tidy(windows.named_features(segment_px(s, d)), "series_id", "i", daily_vol_5d="daily_vol_5d", sma_50_200_ratio="sma_50_200_ratio", rate_of_change_20d="rate_of_change_20d", volume_zscore_20d="volume_zscore_20d")


# ---- paths and signatures ------------------------------------------------------------------------------------------
_PATH = f"{SEG}, {RET}, p AS (SELECT *, sum(coalesce(ret, 0) * sqrt(252.0)) OVER {WALL} AS x, (i - 1) / (count(*) OVER (PARTITION BY series_id) - 1.0) AS t FROM rt)"


@register(f"WITH {_PATH} SELECT series_id, i, {r('x', 5)} AS x, {r('t')} AS t, {r('close / first_value(close) OVER ' + WALL)} AS state FROM p")
def path_transform(s, d):
    df = paths.transformed_path(paths.scaled_path(windows.log_return(segment_px(s, d))), "close", ("state",), "state")
    return tidy(df, "series_id", "i", x=F.round("x", 5), t="t", state="state")


@register(f"""WITH {_PATH}, z AS (SELECT *, lag(x) OVER ({W}) AS lx, lag(t) OVER ({W}) AS lt, lag(x, 20) OVER ({W}) AS ax, lag(t, 20) OVER ({W}) AS at FROM p),
u AS (SELECT a.series_id, a.i, any_value(a.x - a.ax) AS s_x, any_value(a.t - a.at) AS s_t, sum((b.lx - a.ax) * (b.x - b.lx)) AS s_xx, sum((b.lt - a.at) * (b.x - b.lx)) AS s_tx, sum((b.lx - a.ax) * (b.t - b.lt)) AS s_xt FROM z a JOIN z b ON b.series_id = a.series_id AND b.i BETWEEN a.i - 19 AND a.i WHERE a.i >= 21 GROUP BY 1, 2)
SELECT series_id, i, {r('s_x', 4)} AS s_x, {r('s_t', 4)} AS s_t, {r('s_xx', 4)} AS s_xx, {r('s_tx', 4)} AS s_tx, {r('s_xt', 4)} AS s_xt FROM u""")
def subpath_sig2(s, d):
    df = paths.iterated_sums(paths.scaled_path(windows.log_return(segment_px(s, d))), 21).filter("i >= 21")
    return tidy(df, "series_id", "i", s_x="s_x", s_t="s_t", s_xx="s_xx", s_tx="s_tx", s_xt="s_xt", digits=4)


@register(f"""WITH {_PATH}, b AS (SELECT *, (i - 1) // 20 AS block, lag(x) OVER (PARTITION BY series_id, (i - 1) // 20 ORDER BY i) AS lx, lag(t) OVER (PARTITION BY series_id, (i - 1) // 20 ORDER BY i) AS lt FROM p)
SELECT series_id, block, {r('arg_max(x, i) - arg_min(x, i)', 4)} AS delta_x, {r('sum((x + lx) / 2 * (t - lt))', 4)} AS area_x FROM b GROUP BY 1, 2 HAVING count(*) = 20""")
def sig_area(s, d):
    df = paths.area_features(paths.scaled_path(windows.log_return(segment_px(s, d))), 20)
    return tidy(df, "series_id", F.col("block").cast("long").alias("block"), delta_x="delta_x", area_x="area_x", digits=4)


@register(f"""WITH {SEG}, {RET}, z AS (SELECT series_id, i, coalesce(ret, 0) - lag(coalesce(ret, 0), 20) OVER ({W}) AS s FROM rt) SELECT series_id, i, {r('s', 5)} AS sig_1, {r('s * s / 2', 5)} AS sig_2, {r('s * s * s / 6', 5)} AS sig_3, {r('s * s * s * s / 24', 5)} AS sig_4 FROM z WHERE i >= 21 AND (i - 21) % 5 = 0""")
def sig_power(s, d):
    df = paths.power_signature(windows.log_return(segment_px(s, d), first="zero"), 21, "ret", 4, 5)
    return tidy(df, "series_id", "i", sig_1="sig_1", sig_2="sig_2", sig_3="sig_3", sig_4="sig_4", digits=5)


@register(f"""WITH {_PATH}, n AS (SELECT *, lead(x) OVER ({W}) AS nx FROM p) SELECT a.series_id, a.i, {r('sum(b.x * (b.nx - b.x))', 3)} AS a_xx, {r('sum(b.t * (b.nx - b.x))', 3)} AS a_tx FROM n a JOIN n b ON b.series_id = a.series_id AND b.i BETWEEN a.i - 19 AND a.i - 1 WHERE a.i >= 20 GROUP BY 1, 2""")
def sig_absolute(s, d):
    df = paths.absolute_products(paths.scaled_path(windows.log_return(segment_px(s, d))), 20).filter("i >= 20")
    return tidy(df, "series_id", "i", a_xx="a_xx", a_tx="a_tx", digits=3)


@register(f"WITH {SEG} SELECT series_id, CAST((i - 20) // 5 AS INT) AS sub_id, i - 19 AS start_i, i AS end_i, ts AS end_ts FROM px WHERE i >= 20 AND (i - 20) % 5 = 0")
def subpath_table(s, d):
    return paths.subpaths(segment_px(s, d), 20, 5)


@register(f"WITH {SEG}, s AS (SELECT series_id, (i - 20) // 20 AS sub_id FROM px WHERE i >= 20 AND (i - 20) % 20 = 0), n AS (SELECT series_id, max(sub_id) + 1 AS n FROM s GROUP BY 1) SELECT s.series_id, sub_id AS ensemble, sub_id AS first_sub, sub_id + 3 AS last_sub FROM s JOIN n USING (series_id) WHERE sub_id + 4 <= n")
def ensemble_table(s, d):
    return paths.ensembles(paths.subpaths(segment_px(s, d), 20, 20), 4)


# ---- kernels -------------------------------------------------------------------------------------------------------
_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_K = "exp(-list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 50.0)"
_SUMS = f"{_E}, k AS (SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, {_K} AS k FROM e a JOIN e b ON a.vec_id < b.vec_id), s AS (SELECT a, b, sum(k) AS s, count(*) AS n FROM k GROUP BY 1, 2)"


@register(f"WITH {_SUMS} SELECT a, b, {r('s', 4)} AS s, n FROM s")
def rbf_pairs(s, d):
    return tidy(kernels.group_kernel_sums(table(s, d, "embeddings"), "embedding", "label", sigma=5.0), "a", "b", "n", s="s", digits=4)


@register(f"""WITH {_SUMS}, c AS (SELECT label, count(*) AS n FROM e GROUP BY 1) SELECT s.a, s.b, {r('x.s * 2 / (ca.n * (ca.n - 1)) + y.s * 2 / (cb.n * (cb.n - 1)) - 2 * s.s / (ca.n * cb.n)', 7)} AS mmd2
FROM s JOIN s x ON x.a = s.a AND x.b = s.a JOIN s y ON y.a = s.b AND y.b = s.b JOIN c ca ON ca.label = s.a JOIN c cb ON cb.label = s.b WHERE s.a < s.b""")
def mmd2_labels(s, d):
    return tidy(kernels.group_mmd2(table(s, d, "embeddings"), "embedding", "label", sigma=5.0), "a", "b", mmd2="mmd2", digits=7)


_Z = f"{SEG}, {RET}, z AS (SELECT series_id, i, coalesce(ret, 0) AS ret, coalesce(ret, 0) * coalesce(ret, 0) AS sq FROM rt)"


def _sums(c: str, w: str) -> str:
    return f"sum({c}) OVER {w}"


_LATE, _EARLY = f"({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", f"({W} ROWS BETWEEN 59 PRECEDING AND 20 PRECEDING)"


@register(f"""WITH {_Z} SELECT series_id, i, {r(f'CASE WHEN i >= 60 THEN (sum(ret) OVER {_EARLY} * sum(ret) OVER {_EARLY} - sum(ret * ret) OVER {_EARLY} + sum(sq) OVER {_EARLY} * sum(sq) OVER {_EARLY} - sum(sq * sq) OVER {_EARLY}) / (40.0 * 39) + (sum(ret) OVER {_LATE} * sum(ret) OVER {_LATE} - sum(ret * ret) OVER {_LATE} + sum(sq) OVER {_LATE} * sum(sq) OVER {_LATE} - sum(sq * sq) OVER {_LATE}) / (20.0 * 19) - 2 * (sum(ret) OVER {_EARLY} * sum(ret) OVER {_LATE} + sum(sq) OVER {_EARLY} * sum(sq) OVER {_LATE}) / 800.0 END', 6)} AS score FROM z""")
def ref_test_mmd(s, d):
    df = windows.log_return(segment_px(s, d), first="zero").withColumn("sq", F.col("ret") * F.col("ret"))
    return tidy(kernels.reference_scores(df, ["ret", "sq"], 40, 20), "series_id", "i", score="score")


_B = f"{ONE}, {RET}, z AS (SELECT i, ret, ret * ret AS sq FROM rt WHERE ret IS NOT NULL), k AS (SELECT a.i AS p, b.i AS q, exp(-((a.ret - b.ret) * (a.ret - b.ret) + (a.sq - b.sq) * (a.sq - b.sq)) / 2) AS k FROM z a JOIN z b ON abs(a.i - b.i) <= 15)"


@register(f"""WITH {_B}, e AS (SELECT i AS e FROM z WHERE i + 7 <= (SELECT max(i) FROM z)), l AS (SELECT * FROM (VALUES (4, 0.6), (8, 0.4)) v(lag, w)),
own AS (SELECT e, sum(k) AS own FROM e JOIN k ON p BETWEEN e AND e + 7 AND q BETWEEN e AND e + 7 AND p <> q GROUP BY 1),
cr AS (SELECT e, lag, any_value(w) AS w, sum(k) AS cr FROM e, l, k WHERE p BETWEEN e AND e + 7 AND q BETWEEN e - lag AND e - lag + 7 GROUP BY 1, 2)
SELECT 'orders' AS series_id, cr.e AS i, {r('sum(w * (x.own / 56 + y.own / 56 - 2 * cr / 64))', 7)} AS score FROM cr JOIN own x ON x.e = cr.e JOIN own y ON y.e = cr.e - lag GROUP BY cr.e HAVING count(*) = 2""")
def mmd_lag_score(s, d):
    df = windows.log_return(orders_px(s, d)).withColumn("v", F.when(F.col("ret").isNotNull(), F.array("ret", F.col("ret") * F.col("ret"))))
    return tidy(kernels.lag_scores(df, "v", 8, {4: 0.6, 8: 0.4}, sigma=1.0), "series_id", "i", score="score", digits=7)


@register(f"""WITH {SEG}, {RET}, b AS (SELECT series_id || '/' || ((i - 1) // 20) AS g, i, coalesce(ret, 0) AS x, close / 100000 AS y FROM rt),
m AS (SELECT a.g, quantile_cont((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y), 0.5) AS med FROM b a JOIN b c ON a.g = c.g AND a.i < c.i GROUP BY 1)
SELECT g, {r('sqrt(med / 2)')} AS sigma, {r('CASE WHEN med > 0 THEN 1 / med ELSE 1.0 END', 4)} AS gamma FROM m""")
def median_bandwidth(s, d):
    df = windows.log_return(segment_px(s, d), first="zero").withColumn("g", F.concat("series_id", F.lit("/"), F.floor((F.col("i") - 1) / 20).cast("string"))).withColumn("v", F.array("ret", F.col("close") / 100000))
    return tidy(kernels.median_bandwidth(df, "v", "i", "g"), "g", sigma="sigma", gamma=F.round("gamma", 4))


# ---- thresholds ----------------------------------------------------------------------------------------------------
@register(f"WITH {SEG}, {RET}, z AS (SELECT series_id, i, abs(ret) AS score FROM rt), q AS (SELECT series_id, quantile_cont(score, 0.95) AS q FROM z GROUP BY 1) SELECT z.series_id, i, {r('q')} AS threshold, coalesce(score > q, false) AS is_change FROM z JOIN q USING (series_id)")
def percentile_changes(s, d):
    df = windows.log_return(segment_px(s, d)).withColumn("score", F.abs("ret"))
    return tidy(thresholds.percentile_flag(df, 0.95), "series_id", "i", "is_change", threshold="threshold")


@register(f"""WITH RECURSIVE {SEG}, {RET}, z AS (SELECT series_id, i, abs(ret) AS score FROM rt), q AS (SELECT series_id, quantile_cont(score, 0.9) AS q FROM z GROUP BY 1), h AS (SELECT z.series_id, i FROM z JOIN q USING (series_id) WHERE score > q),
k AS (SELECT series_id, min(i) AS i FROM h GROUP BY 1 UNION ALL SELECT k.series_id, (SELECT min(h.i) FROM h WHERE h.series_id = k.series_id AND h.i >= k.i + 20) FROM k WHERE k.i IS NOT NULL) SELECT series_id, i FROM k WHERE i IS NOT NULL""")
def nms_changes(s, d):
    df = windows.log_return(segment_px(s, d)).withColumn("score", F.abs("ret"))
    return thresholds.spaced(thresholds.percentile_flag(df, 0.9, out="hit"), "hit", 20).filter("is_change").select("series_id", "i")


_Z504 = f"count(score) OVER {fr(504)} >= 20"


@register(f"""WITH {SEG}, {RET}, z AS (SELECT series_id, i, abs(ret) AS score FROM rt), m AS (SELECT *, CASE WHEN {_Z504} THEN avg(score) OVER {fr(504)} END AS mu, stddev_pop(score) OVER {fr(504)} AS sd FROM z),
f AS (SELECT m.*, k FROM m, (VALUES (1.0), (1.5), (2.5)) v(k)), n AS (SELECT series_id, k, sum(CAST(coalesce(score > mu + k * sd, false) AS INT)) / count(score) AS share FROM f GROUP BY 1, 2), c AS (SELECT series_id, coalesce(min(k) FILTER (WHERE share <= 0.05), 2.5) AS k FROM n GROUP BY 1)
SELECT m.series_id, i, {r('k')} AS k, {r('mu + k * sd')} AS threshold, coalesce(score > mu + k * sd, false) AS is_change FROM m JOIN c USING (series_id)""")
def ladder_z(s, d):
    df = windows.log_return(segment_px(s, d)).withColumn("score", F.abs("ret"))
    return tidy(thresholds.rolling_z(df, ks=(1.0, 1.5, 2.5), most=0.05), "series_id", "i", "is_change", k="k", threshold="threshold")


@register(f"WITH {SEG}, {RET}, z AS (SELECT series_id, i, abs(ret) AS score FROM rt), q AS (SELECT series_id, quantile_cont(score, 0.95) AS q FROM z GROUP BY 1) SELECT count(DISTINCT series_id) AS series, sum(CAST(score > q AS INT)) AS changes, {r('avg(q)', 5)} AS mean_threshold FROM z JOIN q USING (series_id) WHERE score IS NOT NULL")
def cross_series_summary(s, d):
    df = thresholds.percentile_flag(windows.log_return(segment_px(s, d)).withColumn("score", F.abs("ret")), 0.95).dropna(subset=["score"])
    out = df.agg(F.countDistinct("series_id").alias("series"), F.sum(F.col("is_change").cast("long")).alias("changes"), F.avg("threshold").alias("mean_threshold"))
    return tidy(out, "series", "changes", mean_threshold="mean_threshold", digits=5)


def _scored(s: SparkSession, d: str) -> DataFrame:
    return windows.log_return(segment_px(s, d)).withColumn("score", F.abs("ret")).select("series_id", "i", "ts", "score")


_SC = f"{SEG}, {RET}, z AS (SELECT series_id, i, abs(ret) AS score FROM rt)"


def _kept(width: int, *keys: str) -> str:
    """The hits h that greedy suppression keeps, as a recursive table k."""
    by = ", ".join(("series_id", *keys))
    same = " AND ".join(f"h.{c} = k.{c}" for c in ("series_id", *keys))
    return f"k AS (SELECT {by}, min(i) AS i FROM h GROUP BY {by} UNION ALL SELECT {', '.join('k.' + c for c in ('series_id', *keys))}, (SELECT min(h.i) FROM h WHERE {same} AND h.i >= k.i + {width}) FROM k WHERE k.i IS NOT NULL)"


@register(f"""WITH RECURSIVE {_SC}, f AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[]) AS calm, CAST(NULL AS DOUBLE) AS lim, false AS ch FROM z
UNION ALL SELECT series_id, i, CASE WHEN score IS NOT NULL AND NOT ch THEN list_append(calm, score)[-200:] ELSE calm END, lim, ch FROM (SELECT *, coalesce(score > lim, false) AS ch
FROM (SELECT z.series_id, z.i, z.score, f.calm, CASE WHEN len(f.calm) >= 50 THEN list_aggregate(f.calm, 'quantile_cont', 0.95) END AS lim FROM f JOIN z ON z.series_id = f.series_id AND z.i = f.i + 1) x) y)
SELECT series_id, i, {r('lim')} AS threshold, ch AS is_change FROM f WHERE i > 0""")
def feedback_changes(s, d):
    return tidy(thresholds.feedback_percentile(_scored(s, d)), "series_id", "i", "is_change", threshold="threshold")


@register()
def gamma_changes(s, d):
    return tidy(thresholds.gamma_limit(_scored(s, d)), "series_id", "i", "is_change", threshold="threshold")


_M51 = f"({W} ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)"


@register(f"""WITH RECURSIVE {_SC}, al AS (SELECT series_id, quantile_cont(score, 0.5) AS al, quantile_cont(score, 0.6) AS fl FROM z GROUP BY 1),
m AS (SELECT z.*, CASE WHEN count(*) OVER {_M51} = 51 THEN quantile_cont(score, 0.5) OVER {_M51} ELSE al END AS md, fl FROM z JOIN al USING (series_id)),
t AS (SELECT a.series_id, a.i, max(a.score) AS score, greatest(max(a.md) + 1.5 * 1.4826 * quantile_cont(abs(b.score - a.md), 0.5), max(a.fl)) AS lim FROM m a JOIN m b ON b.series_id = a.series_id AND b.i BETWEEN a.i - 25 AND a.i + 25 GROUP BY 1, 2),
h AS (SELECT series_id, i FROM t WHERE score > lim), {_kept(15)} SELECT t.series_id, t.i, {r('lim')} AS threshold, k.i IS NOT NULL AS is_change FROM t LEFT JOIN k ON k.series_id = t.series_id AND k.i = t.i""")
def mad_changes(s, d):
    return tidy(thresholds.median_mad_limit(_scored(s, d)), "series_id", "i", "is_change", threshold="threshold")


_ALPHAS = (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.6, 0.5)
_STEPS = " UNION ALL ".join(f"SELECT series_id, i, score, {j} AS j, CASE WHEN count(x) OVER {_BEF} >= 10 THEN quantile_cont(x, {a}) OVER {_BEF} END AS lim FROM w" for j, a in enumerate(_ALPHAS))


@register(f"""WITH RECURSIVE {_SC}, w AS (SELECT *, CASE WHEN score > 0 THEN score END AS x FROM z), p AS (SELECT series_id, quantile_cont(score, 0.7) AS lim FROM z GROUP BY 1),
q AS ({_STEPS} UNION ALL SELECT z.series_id, i, score, {len(_ALPHAS)} AS j, lim FROM z JOIN p USING (series_id)), h AS (SELECT series_id, j, i FROM q WHERE score > lim), {_kept(10, 'j')},
n AS (SELECT series_id, j, count(i) AS n FROM k GROUP BY 1, 2), c AS (SELECT p.series_id, coalesce(min(CASE WHEN n BETWEEN 2 AND 100 AND j < {len(_ALPHAS)} THEN j END), {len(_ALPHAS)}) AS j FROM p LEFT JOIN n USING (series_id) GROUP BY 1)
SELECT q.series_id, q.i, {r('q.lim')} AS threshold, k.i IS NOT NULL AS is_change FROM q JOIN c ON c.series_id = q.series_id AND c.j = q.j LEFT JOIN k ON k.series_id = q.series_id AND k.j = q.j AND k.i = q.i""")
def quantile_ladder(s, d):
    return tidy(thresholds.ladder_quantile(_scored(s, d)), "series_id", "i", "is_change", threshold="threshold")


_PASSES = (("a", 0.88, 3), ("b", 0.75, 2), ("c", 0.92, 4))


@register(f"""WITH {_SC}, e AS (SELECT *, CASE WHEN i < 60 THEN 0.0 ELSE coalesce((score - avg(score) OVER {WALL}) / (stddev_samp(score) OVER {WALL} + 1e-8), 0) END AS ez FROM z),
q AS (SELECT series_id, count(score) < 30 AS few, {', '.join(f'quantile_cont(score, {p}) AS s{x}, quantile_cont(ez, {p}) AS z{x}' for x, p, _ in _PASSES)} FROM e GROUP BY 1),
f AS (SELECT e.*, {', '.join(f'CAST(coalesce(CASE WHEN few THEN score > s{x} ELSE ez > z{x} END, false) AS INT) AS f{x}' for x, _, _ in _PASSES)} FROM e JOIN q USING (series_id)),
g AS (SELECT series_id, i, {', '.join(f'sum(f{x}) OVER {fr(n)} >= {n} AS {x}' for x, _, n in _PASSES)} FROM f), n AS (SELECT series_id, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE c) AS nc FROM g GROUP BY 1)
SELECT g.series_id, i, CASE WHEN na = 0 THEN b WHEN na > 40 AND nc BETWEEN 2 AND 40 THEN c ELSE a END AS is_change FROM g JOIN n USING (series_id)""")
def two_pass_changes(s, d):
    return thresholds.two_pass(_scored(s, d)).select("series_id", "i", "is_change")


@register()
def permutation_threshold(s, d):
    df = windows.log_return(segment_px(s, d), first="zero").filter("i <= 60").withColumn("v", F.array("ret", F.col("close") / 100000)).withColumn("late", F.col("i") > 40)
    return tidy(thresholds.permutation_test(df, "v", "late", "series_id"), "series_id", stat="stat", threshold="threshold", p_value="p_value")


# ---- segments ------------------------------------------------------------------------------------------------------
_SEGS = f"{REGIME}, c AS (SELECT *, coalesce(CAST(regime <> lag(regime) OVER ({W}) AS INT), 0) AS ch FROM g), sg AS (SELECT *, sum(ch) OVER {WALL} AS seg FROM c)"


@register(f"WITH {REGIME} SELECT series_id, ts, i, {r('vol')} AS vol, regime, {r('confidence')} AS confidence, coalesce(CAST(regime <> lag(regime) OVER ({W}) AS INT), 0) AS transition_flag FROM g")
def vol_tercile_regime(s, d):
    return tidy(windows.change_flag(regimes(s, d), "regime"), "series_id", "ts", "i", "regime", "transition_flag", vol="vol", confidence="confidence")


@register(f"WITH {_SEGS} SELECT series_id, CAST(seg AS INT) AS seg, min(regime) AS regime, min(ts) AS start_ts, max(ts) AS end_ts, CAST(count(*) AS INT) AS n_days FROM sg GROUP BY 1, 2")
def dwell_segments(s, d):
    return segments.segments(regimes(s, d))


@register(f"""WITH {_SEGS}, dd AS (SELECT *, close / max(close) OVER (PARTITION BY series_id, seg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM sg)
SELECT series_id, CAST(seg AS INT) AS seg, min(regime) AS regime, CAST(count(*) AS INT) AS n_days, {r('avg(ret)')} AS mean_ret, {r('stddev_samp(ret)')} AS vol, {r('min(dd)')} AS max_dd, {r('arg_max(close, i) / arg_min(close, i) - 1')} AS total_ret, {r('avg(ret) / (stddev_samp(ret) + 1e-12)')} AS sharpe FROM dd GROUP BY 1, 2""")
def segment_stats(s, d):
    return tidy(segments.segment_stats(regimes(s, d)), "series_id", "seg", "regime", "n_days", mean_ret="mean_ret", vol="vol", max_dd="max_dd", total_ret="total_ret", sharpe="sharpe")


@register(f"WITH {REGIME} SELECT series_id, i, dense_rank() OVER (PARTITION BY series_id ORDER BY regime * 3 + 7) - 1 AS regime FROM g")
def relabel_dense(s, d):
    return segments.relabeled(regimes(s, d).withColumn("regime", F.col("regime") * 3 + 7)).select("series_id", "i", "regime")


@register(f"WITH {SEG}, m AS (SELECT series_id, i, CASE WHEN i > 1 AND (i - 1) % 100 = 0 THEN 1 ELSE 0 END AS m FROM px) SELECT series_id, i, CAST(sum(m) OVER {WALL} AS INT) AS regime FROM m")
def change_days(s, d):
    df = segment_px(s, d)
    cps = df.filter("i % 20 = 1 and i > 1 and (i - 1) % 100 = 0").select("series_id", F.floor((F.col("i") - 1) / 20).alias("cp"))
    return segments.from_change_days(df, cps, step=20).select("series_id", "i", "regime")


@register(f"""WITH {REGIME}, en AS (SELECT series_id, i - 1 AS e, regime FROM g WHERE i <= (SELECT max(i) FROM g h WHERE h.series_id = g.series_id) - 9), l AS (SELECT series_id, max(e) AS last FROM en GROUP BY 1)
SELECT g.series_id, g.i, en.regime AS painted FROM g JOIN l USING (series_id) JOIN en ON en.series_id = g.series_id AND en.e = least(g.i - 1, l.last)""")
def ensemble_days(s, d):
    df = regimes(s, d)
    ens = df.withColumn("n", F.count("*").over(whole())).filter("i <= n - 9").select("series_id", (F.col("i") - 1).alias("ensemble"), F.col("regime").alias("painted"))
    return segments.ensemble_days(df, ens, "painted", span=10).select("series_id", "i", "painted")


@register(f"""WITH {REGIME}, sm AS (SELECT series_id, i, CASE WHEN (i - 1) % 7 = 0 THEN regime END AS label FROM g) SELECT series_id, i, coalesce(first_value(label IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(label IGNORE NULLS) OVER {WALL}) AS regime FROM sm""")
def sampled_labels(s, d):
    df = regimes(s, d).withColumn("label", F.when((F.col("i") - 1) % 7 == 0, F.col("regime")))
    return segments.sampled_labels(df).select("series_id", "i", "regime")


@register(f"""WITH {REGIME}, en AS (SELECT series_id, i AS e, regime FROM g), x AS (SELECT en.series_id, en.regime, g.ret FROM en JOIN g ON g.series_id = en.series_id AND g.i BETWEEN en.e AND en.e + 4 WHERE g.ret IS NOT NULL)
SELECT series_id, regime, count(*) AS n, {r('avg(ret)')} AS mean_ret, {r('stddev_pop(ret)')} AS vol FROM x GROUP BY 1, 2""")
def overlap_profile(s, d):
    df = regimes(s, d)
    ens = df.select("series_id", (F.col("i") - 1).alias("ensemble"), "regime")
    return tidy(segments.overlap_stats(df.drop("regime"), ens, span=5), "series_id", "regime", "n", mean_ret="mean_ret", vol="vol")


def _merging(limit: int, right_wins: str) -> str:
    """Runs as a list of (label, n), of which one step gives the first run under ``limit`` rows a neighbour's label and joins it with
    neighbours of that label; ``right_wins`` decides between two neighbours."""
    size = lambda v: f"list_sum(list_transform(list_filter(l, lambda x: x.label = {v}), lambda x: x.n))"
    wins = right_wins.format(right="l[p + 1]", left="l[p - 1]", right_size=size("l[p + 1].label"), left_size=size("l[p - 1].label"))
    return f"""{_SEGS}, rn AS (SELECT series_id, seg, min(regime) AS label, count(*) AS n FROM sg GROUP BY 1, 2),
st AS (SELECT series_id, 0 AS step, list({{'label': CAST(label AS INT), 'n': CAST(n AS INT)}} ORDER BY seg) AS l FROM rn GROUP BY 1
UNION ALL SELECT series_id, step + 1, list_concat(list_concat(CASE WHEN p > 1 AND l[p - 1].label <> v THEN l[1:p - 1] WHEN p > 2 THEN l[1:p - 2] ELSE l[1:0] END,
[{{'label': v, 'n': CAST(l[p].n + CASE WHEN p > 1 AND l[p - 1].label = v THEN l[p - 1].n ELSE 0 END + CASE WHEN p < len(l) AND l[p + 1].label = v THEN l[p + 1].n ELSE 0 END AS INT)}}]),
CASE WHEN p < len(l) AND l[p + 1].label <> v THEN l[p + 1:] WHEN p + 1 < len(l) THEN l[p + 2:] ELSE l[1:0] END)
FROM (SELECT *, CASE WHEN p = 1 THEN l[2].label WHEN p = len(l) THEN l[p - 1].label WHEN {wins} THEN l[p + 1].label ELSE l[p - 1].label END AS v
FROM (SELECT *, CAST(list_position(list_transform(l, lambda x: x.n < {limit}), true) AS BIGINT) AS p FROM st) x WHERE p > 0 AND len(l) > 1) y),
fin AS (SELECT series_id, arg_max(l, step) AS l FROM st GROUP BY 1), un AS (SELECT series_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS k FROM fin),
ends AS (SELECT series_id, x.label AS label, x.n AS n, sum(x.n) OVER (PARTITION BY series_id ORDER BY k) AS last FROM un)
SELECT g.series_id, g.i, ends.label AS regime FROM g JOIN ends ON ends.series_id = g.series_id AND g.i BETWEEN last - n + 1 AND last"""


@register(f"WITH RECURSIVE {_merging(15, '{right_size} > {left_size}')}")
def merge_regime(s, d):
    return segments.merged(regimes(s, d), policy="regime", limit=15).select("series_id", "i", "regime")


@register(f"WITH RECURSIVE {_merging(5, '{left}.n < {right}.n')}")
def merge_neighbor(s, d):
    return segments.merged(regimes(s, d), policy="neighbor", limit=5).select("series_id", "i", "regime")


@register(f"WITH {SEG} SELECT series_id, i, CAST(least((i - 1) // greatest(count(*) OVER (PARTITION BY series_id) // 4, 1), 3) AS INT) AS regime FROM px")
def equal_chunks(s, d):
    return segments.equal_chunks(segment_px(s, d), 4).select("series_id", "i", "regime")


# ---- labels, confidences, forecasts --------------------------------------------------------------------------------
_PROF = f"{REGIME}, pr AS (SELECT series_id, regime, count(ret) AS n, avg(ret) AS mean_ret, stddev_pop(ret) AS vol, avg(CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS INT) ELSE NULL END) AS win_rate FROM g GROUP BY 1, 2)"


@register(f"WITH {_PROF} SELECT series_id, regime, n, {r('mean_ret')} AS mean_ret, {r('vol')} AS vol, {r('win_rate')} AS win_rate FROM pr")
def regime_profile(s, d):
    return tidy(labels.profile(regimes(s, d)), "series_id", "regime", "n", mean_ret="mean_ret", vol="vol", win_rate="win_rate")


@register(f"""WITH {_PROF}, qq AS (SELECT series_id, quantile_cont(vol, 0.5) AS m, quantile_cont(vol, 0.75) AS hi, quantile_cont(vol, 0.25) AS lo FROM pr GROUP BY 1),
k AS (SELECT pr.*, m, hi, lo, row_number() OVER (PARTITION BY series_id ORDER BY mean_ret, regime) AS rk, row_number() OVER (PARTITION BY series_id ORDER BY vol, mean_ret DESC, regime) AS rv, count(*) OVER (PARTITION BY series_id) AS nr FROM pr JOIN qq USING (series_id))
SELECT series_id, regime, CASE WHEN mean_ret > 0 AND vol < m THEN 'bull' WHEN mean_ret < 0 AND vol > m THEN 'bear' WHEN vol > hi THEN 'high_volatility' WHEN vol < lo THEN 'low_volatility' ELSE 'normal_' || regime END AS by_volatility,
CASE WHEN nr = 1 THEN 'sideways' WHEN nr = 2 THEN CASE WHEN rk = 1 THEN 'bear' ELSE 'bull' END ELSE CASE rk WHEN 1 THEN 'bear' WHEN 2 THEN 'sideways' WHEN 3 THEN 'bull' END END AS by_return,
CASE WHEN nr = 1 THEN 'sideways' WHEN nr = 2 THEN CASE WHEN rk = 1 THEN 'bear' ELSE 'bull' END WHEN rv = nr THEN 'bear' WHEN rv = 1 THEN 'bull' ELSE 'sideways' END AS by_risk FROM k""")
def label_rank(s, d):
    stats = labels.profile(regimes(s, d))
    out = labels.name_by_volatility(stats).withColumnRenamed("label", "by_volatility")
    out = labels.name_by_return(out).withColumnRenamed("label", "by_return")
    return labels.name_by_risk(out).select("series_id", "regime", "by_volatility", "by_return", F.col("label").alias("by_risk"))


@register(f"""WITH {_SEGS}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id, seg ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY series_id, seg) AS n FROM sg)
SELECT series_id, i, {r('CASE WHEN n <= 1 THEN 0.5 ELSE greatest(0.0, least(1.0, 0.5 + 0.5 * least(pos, n - 1 - pos) / (n / 2.0))) END')} AS edge, {r('greatest(0.0, least(1.0, 1 - vol / max(vol) OVER (PARTITION BY series_id)))')} AS by_score FROM n""")
def edge_confidence(s, d):
    df = labels.edge_confidence(segments.numbered(regimes(s, d)), out="edge")
    return tidy(labels.score_confidence(df, "vol", "by_score"), "series_id", "i", edge="edge", by_score="by_score")


@register(f"""WITH {REGIME}, p AS (SELECT series_id, quantile_cont(vol, 0.05) AS lo, quantile_cont(vol, 0.95) AS hi, quantile_cont(vol, 0.99) AS p99, max(vol) AS mx FROM g GROUP BY 1)
SELECT series_id, i, {r('greatest(0.1, least(1.0, 1 - greatest(0.0, least(1.0, (vol - p.lo) / (p.hi - p.lo)))))')} AS by_percentile, {r('greatest(0.0, least(1.0, 1 - vol / mx))')} AS nearest, {r('least(1.0, vol / p99)')} AS share, {r('vol / (vol + mx + 1e-12)')} AS ratio, {r('greatest(0.0, least(1.0, vol / (2 * mx)))')} AS half FROM g JOIN p USING (series_id)""")
def distance_confidence(s, d):
    df = regimes(s, d).withColumn("mx", F.max("vol").over(whole()))
    df = labels.nearest_confidence(labels.percentile_confidence(df, "vol", "by_percentile"), "vol", "nearest")
    df = labels.threshold_confidence(labels.ratio_confidence(labels.score_share_confidence(df, "vol", out="share"), "mx", "vol", "ratio"), "vol", "mx", "half")
    return tidy(df, "series_id", "i", by_percentile="by_percentile", nearest="nearest", share="share", ratio="ratio", half="half")


@register(f"WITH {REGIME} SELECT series_id, i, {r('avg(ret) OVER (PARTITION BY series_id, regime)')} AS regime_return_forecast, {r('avg(vol) OVER (PARTITION BY series_id, regime)')} AS regime_vol_forecast FROM g")
def forecast_by_regime(s, d):
    return tidy(labels.forecasts(regimes(s, d)), "series_id", "i", regime_return_forecast="regime_return_forecast", regime_vol_forecast="regime_vol_forecast")


@register(f"WITH {_SEGS} SELECT series_id, seg // 10 AS part, count(ret) AS n, {r('skewness(ret)', 5)} AS skew, {r('kurtosis(ret)', 5)} AS kurt FROM sg GROUP BY 1, 2 HAVING count(ret) >= 4")
def segment_moments(s, d):
    df = segments.numbered(regimes(s, d)).withColumn("part", F.floor(F.col("seg") / 10))
    return tidy(labels.moments(df, "part").filter("n >= 4"), "series_id", "part", "n", skew="skew", kurt="kurt", digits=5)


# ---- contract ------------------------------------------------------------------------------------------------------
@register(f"""WITH {REGIME}, o AS (SELECT series_id, ts, i, regime, coalesce(CAST(regime <> lag(regime) OVER ({W}) AS INT), 0) AS flag, round_even(confidence, 4) AS confidence, ts - lag(ts) OVER ({W}) AS gap FROM g), a AS (SELECT series_id, count(*) FILTER (WHERE gap > 5) AS date_gap, max(regime) + 1 - count(DISTINCT regime) AS regime_gaps, count(*) FILTER (WHERE confidence IS NULL OR confidence NOT BETWEEN 0 AND 1) AS confidence_range, CAST(avg(flag) > 0.3 AS INT) AS transition_rate, CAST(count(*) < 100 AS INT) AS few_rows FROM o GROUP BY 1)
SELECT series_id, "check", CAST(bad AS BIGINT) AS bad FROM (UNPIVOT a ON date_gap, regime_gaps, confidence_range, transition_rate, few_rows INTO NAME "check" VALUE bad)""")
def contract_checks(s, d):
    return contract.checks(contract.to_output(regimes(s, d))).filter(F.col("check").isin("date_gap", "regime_gaps", "confidence_range", "transition_rate", "few_rows"))


# ---- evaluation ----------------------------------------------------------------------------------------------------
@register(f"""WITH {_SEGS}, a AS (SELECT series_id, count(*) AS n_days, count(DISTINCT seg) AS segments FROM sg GROUP BY 1), m AS (SELECT *, n_days / segments AS md, (segments - 1) / greatest(n_days - 1, 1) AS tr FROM a)
SELECT series_id, n_days, segments, {r('md')} AS mean_dwell, {r('tr')} AS transition_rate, {r('CASE WHEN segments = 1 THEN 12.0 ELSE (CASE WHEN md >= 21 THEN 15.0 WHEN md >= 10 THEN 10 + (md - 10) / 11 * 5 WHEN md >= 5 THEN 5 + (md - 5) WHEN md >= 2 THEN md ELSE 0.0 END) * (CASE WHEN tr > 0.3 THEN 0 WHEN tr > 0.2 THEN 0.5 WHEN tr > 0.1 THEN 0.8 ELSE 1.0 END) END')} AS score FROM m""")
def stability_score(s, d):
    return tidy(evaluate.stability(regimes(s, d)), "series_id", "n_days", "segments", mean_dwell="mean_dwell", transition_rate="transition_rate", score="score")


@register(f"""WITH {ONE}, {RET}, f AS (SELECT i, {full('sum(ret)', 'ret', 20)} AS x, ({full('stddev_samp(ret)', 'ret', 20)}) * sqrt(252.0) AS y FROM rt), k AS (SELECT i, x, y, CAST(y > (SELECT quantile_cont(y, 0.5) FROM f) AS INT) AS l FROM f WHERE x IS NOT NULL AND y IS NOT NULL),
m AS (SELECT a.i, a.l, b.l AS o, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS s, count(*) AS n FROM k a JOIN k b ON true GROUP BY 1, 2, 3), w AS (SELECT i, max(CASE WHEN l = o THEN s / (n - 1) END) AS a, min(CASE WHEN l <> o THEN s / n END) AS b FROM m GROUP BY 1)
SELECT count(*) AS n, {r('avg((b - a) / greatest(a, b))', 5)} AS silhouette FROM w""")
def silhouette(s, d):
    df = evaluate.separability_features(orders_px(s, d))
    df = df.withColumn("l", (F.col("vol_20") > F.percentile("vol_20", 0.5).over(whole())).cast("int"))
    return tidy(evaluate.silhouette(df, ["ret_20", "vol_20"], "l"), "n", silhouette="silhouette", digits=5)


@register(f"""WITH {REGIME}, x AS (SELECT *, CAST(({full('avg(close)', 'close', 50)}) > ({full('avg(close)', 'close', 200)}) AS INT) AS p FROM g), c AS (SELECT series_id, regime AS a, p AS b, count(*) AS n FROM x WHERE p IS NOT NULL GROUP BY 1, 2, 3), s AS (SELECT series_id, sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c GROUP BY 1),
sa AS (SELECT series_id, sum(n * (n - 1) / 2) AS sa FROM (SELECT series_id, a, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1), sb AS (SELECT series_id, sum(n * (n - 1) / 2) AS sb FROM (SELECT series_id, b, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT series_id, CAST(n AS BIGINT) AS n, {r('CASE WHEN (sa + sb) / 2 = sa * sb / (n * (n - 1) / 2) THEN 1.0 ELSE (s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) END')} AS ari FROM s JOIN sa USING (series_id) JOIN sb USING (series_id)""")
def ari_proxy(s, d):
    return tidy(evaluate.adjusted_rand(windows.market_proxies(regimes(s, d)), "regime", "sma_cross", keys=("series_id",)), "series_id", "n", ari="ari")


@register(f"WITH {REGIME}, c AS (SELECT series_id, quantile_cont(vol, 0.25) AS a, quantile_cont(vol, 0.5) AS b, quantile_cont(vol, 0.75) AS c FROM g GROUP BY 1) SELECT series_id, i, CAST(vol > a AS INT) + CAST(vol > b AS INT) + CAST(vol > c AS INT) AS bin FROM g JOIN c USING (series_id)")
def qcut_proxy(s, d):
    return evaluate.quantile_bins(regimes(s, d), "vol", 4, "bin").select("series_id", "i", "bin")


@register(f"""WITH {REGIME}, b AS (SELECT *, CASE WHEN i <= 252 THEN 0 ELSE (i - 253) // 21 + 1 END AS blk FROM g), m AS (SELECT a.series_id, a.i, any_value(a.ret) AS ret, avg(p.ret) AS mean FROM b a LEFT JOIN b p ON p.series_id = a.series_id AND p.regime = a.regime AND p.blk < a.blk WHERE a.i > 252 GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN mean > 0 THEN ret ELSE 0.0001 END AS held FROM m), z AS (SELECT series_id, count(*) AS n, avg(held) / stddev_samp(held) * sqrt(252.0) AS sharpe, avg(ret) / stddev_samp(ret) * sqrt(252.0) AS benchmark FROM h GROUP BY 1)
SELECT series_id, n, {r('sharpe', 5)} AS sharpe, {r('benchmark', 5)} AS benchmark FROM z""")
def walkforward_sharpe(s, d):
    df = regimes(s, d).withColumn("safe_ret", F.lit(0.0001))
    return tidy(evaluate.walk_forward(df), "series_id", "n", sharpe="sharpe", benchmark="benchmark", digits=5)


_SPIKE = f"{REGIME}, x AS (SELECT *, count(vol) OVER {fr(252)} >= 252 AND vol > avg(vol) OVER {fr(252)} + 2 * stddev_samp(vol) OVER {fr(252)} AS hot FROM g), h AS (SELECT *, i - lag(i) OVER ({W}) AS gp FROM x WHERE hot), ev AS (SELECT *, sum(CASE WHEN gp IS NULL OR gp > 5 THEN 1 ELSE 0 END) OVER {WALL} AS event FROM h), es AS (SELECT series_id, CAST(event AS INT) AS event, min(ts) AS event_ts, min(i) AS event_i FROM ev GROUP BY 1, 2)"


@register(f"WITH {_SPIKE} SELECT * FROM es")
def spike_events(s, d):
    return evaluate.spike_events(regimes(s, d), "vol")


@register(f"""WITH {_SPIKE}, ch AS (SELECT series_id, ts FROM g QUALIFY regime <> lag(regime) OVER ({W})), mt AS (SELECT es.*, ch.ts - event_ts AS lag FROM es LEFT JOIN ch ON ch.series_id = es.series_id AND ch.ts BETWEEN event_ts - 5 AND event_ts + 10),
bs AS (SELECT series_id, event, event_ts, CAST(arg_min(lag, abs(lag) * 100 + lag) AS INT) AS lag_days FROM mt GROUP BY 1, 2, 3) SELECT series_id, event, event_ts, lag_days, {r('coalesce(greatest(0.0, 1 - abs(lag_days) / 10.0), 0.0)')} AS score FROM bs""")
def event_response(s, d):
    df = regimes(s, d)
    changes = windows.change_flag(df, "regime").filter("transition_flag = 1").select("series_id", "ts")
    return tidy(evaluate.event_response(evaluate.spike_events(df, "vol"), changes), "series_id", "event", "event_ts", "lag_days", score="score")


_PARTS = ("separability", "stability", "alignment", "walk_forward", "responsiveness")


@register(f"""WITH {REGIME}, a AS (SELECT series_id, count(*) AS n_days, round_even(25 * avg(confidence), 6) AS separability, round_even(15 * avg(CAST(regime = 2 AS INT)), 6) AS stability, round_even(25 * avg(CAST(regime < 2 AS INT)), 6) AS alignment,
round_even(25 * min(vol) / max(vol), 6) AS walk_forward, round_even(10 * avg(confidence), 6) AS responsiveness FROM g GROUP BY 1), b AS (SELECT * FROM a UNION ALL SELECT * REPLACE (series_id || '/short' AS series_id, 100 AS n_days) FROM a),
t AS (SELECT series_id, round(CASE WHEN n_days < 252 THEN (separability + stability + alignment + responsiveness) * 100 / 75 ELSE separability + stability + alignment + walk_forward + responsiveness END, 4) AS total FROM b)
SELECT series_id, total, CASE WHEN total >= 85 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 55 THEN 'C' WHEN total >= 40 THEN 'D' ELSE 'F' END AS grade FROM t""")
def composite_grade(s, d):
    """Totals and grades of five made-up scores a series (shares of its confidences, regimes and volatilities), as they are and as of a short series."""
    points = dict(zip(_PARTS, (25 * F.avg("confidence"), 15 * F.avg((F.col("regime") == 2).cast("int")), 25 * F.avg((F.col("regime") < 2).cast("int")), 25 * F.min("vol") / F.max("vol"), 10 * F.avg("confidence"))))
    whole_ = regimes(s, d).groupBy("series_id").agg(F.count("*").alias("n_days"), *[F.bround(c, 6).alias(n) for n, c in points.items()])
    short = whole_.withColumn("series_id", F.concat("series_id", F.lit("/short"))).withColumn("n_days", F.lit(100).cast("long"))
    return evaluate.composite(whole_.unionByName(short)).select("series_id", "total", "grade")


@register()
def evaluator_report(s, d):
    """All five metrics of the tercile regimes, with volatility for the vix and a constant safe return."""
    df = regimes(s, d).withColumn("vix", F.col("vol") * 10).withColumn("safe_ret", F.lit(0.0001))
    stable = evaluate.stability(df).select("series_id", F.col("n_days"), F.col("score").alias("stability"))
    aligned = evaluate.alignment(evaluate.proxies(df)).groupBy("series_id").agg(F.max("score").alias("alignment"))
    walked = evaluate.walk_forward(df).select("series_id", F.col("score").alias("walk_forward"))
    changes = windows.change_flag(df, "regime").filter("transition_flag = 1").select("series_id", "ts")
    quick = evaluate.responsiveness(evaluate.event_response(evaluate.spike_events(df, "vix"), changes), df).select("series_id", F.col("score").alias("responsiveness"))
    separable = evaluate.silhouette(evaluate.separability_features(df).drop("vol_20").withColumn("vol_20", F.col("vol")), ["ret_20", "vol_20"], "regime").select(evaluate.separability_score(F.col("silhouette")).alias("separability"))
    row = stable.join(aligned, "series_id").join(walked, "series_id").join(quick, "series_id").crossJoin(F.broadcast(separable))
    return evaluate.metric_rows(evaluate.composite(row), "tercile")


# ---- clustering, presets, synthetic --------------------------------------------------------------------------------
@register()
def kmeans_features(s, d):
    df = evaluate.separability_features(segment_px(s, d))
    return tidy(clustering.kmeans(df, ["ret_20", "vol_20"], 3, tries=20), "series_id", "i", "regime", d_own="d_own", d_other="d_other")


@register()
def ward_linkage(s, d):
    df = paths.iterated_sums(paths.scaled_path(windows.log_return(orders_px(s, d))), 21)
    df = df.withColumn("sig", F.when(F.col("i") >= 21, F.array("s_t", "s_x", "s_xx")))
    return clustering.ward_regimes(df, "sig", 3, sigma=2.0).select("series_id", "i", "regime")


@register()
def synthetic_switching(s, d):
    return tidy(synthetic.switching_path(s, 1000, series=4), "series_id", "i", "ts", "true_regime", close="close")


def _preset(name: str) -> Query:
    return lambda s, d: presets.run(name, segment_px(s, d)).select("series_id", "ts", "i", "regime", "label", F.round("confidence", 4).alias("confidence"), "transition_flag")


for _name in presets.PRESETS:
    REGISTRY[f"preset_{_name}"] = (_preset(_name), None)
