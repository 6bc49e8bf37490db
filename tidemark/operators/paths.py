"""Paths, sub-paths, ensembles and truncated signatures.

Signatures of sliding sub-paths come from running sums (a difference of two rows), so no sub-path is materialised: with
P_ij the running sum of X_i(s-1) dX_j(s), the strict iterated sum over (a, b] is P_ij(b) - P_ij(a) - X_i(a) (X_j(b) - X_j(a)).
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import expanding, ordered, rows, whole

LAMBDA = math.sqrt(252)


def scaled_path(df: DataFrame, ret: str = "ret", scale: float = LAMBDA) -> DataFrame:
    """x: running sum of scaled returns, starting at 0; t: 0 to 1 over the whole series (looks ahead for its length)."""
    x = F.sum(F.coalesce(F.col(ret), F.lit(0.0)) * scale).over(expanding())
    n = F.count("*").over(whole())
    return df.withColumn("x", x).withColumn("t", F.when(n > 1, (F.col("i") - 1) / (n - 1)).otherwise(0.0))


def transformed_path(df: DataFrame, c: str = "close", steps: tuple[str, ...] = ("time", "state", "incr"), out: str = "x") -> DataFrame:
    """time: t scaled to 0..1; state: divided by the first value; incr: the running sum of absolute steps, plus the first state."""
    df = df.withColumn(out, F.col(c))
    if "time" in steps:
        lo, hi = F.min("i").over(whole()), F.max("i").over(whole())
        df = df.withColumn("t", F.when(hi > lo, (F.col("i") - lo) / (hi - lo)).otherwise(0.0))
    if "state" in steps:
        first = F.first(c, ignorenulls=True).over(expanding())
        df = df.withColumn(out, F.col(out) / F.when(first != 0, first))
    if "incr" in steps:
        df = df.withColumn("_step", F.abs(F.col(out) - F.lag(out).over(ordered())))
        df = df.withColumn("incr", F.coalesce(F.sum("_step").over(expanding()), F.lit(0.0)) + F.first(out, ignorenulls=True).over(expanding())).drop("_step")
    return df


def block_path(df: DataFrame, ret: str = "ret", n: int = 20, out: str = "x") -> DataFrame:
    """The cumulative return inside each disjoint block of n rows, its first return included."""
    df = df.withColumn("block", F.floor((F.col("i") - 1) / n).cast("int"))
    return df.withColumn(out, F.sum(ret).over(expanding("series_id", "block")))


def subpath_transform(df: DataFrame, c: str, n: int, out: str = "channel") -> DataFrame:
    """For each full window of n rows: the values z-scored (population), differenced, z-scored again, as an array."""
    frame = F.collect_list(c).over(rows(n))
    df = df.withColumn("_v", F.when(F.count(c).over(rows(n)) == n, frame))
    return df.withColumn("_z", zscored("_v")).withColumn("_d", F.zip_with(F.slice("_z", 2, n), F.slice("_z", 1, n - 1), lambda b, a: b - a)).withColumn(out, zscored("_d")).drop("_v", "_z", "_d")


def zscored(name: str) -> Column:
    """An array's values less their mean over the population deviation + 1e-12."""
    v = F.col(name)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    var = F.aggregate(F.transform(v, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return F.transform(v, lambda x: (x - mean) / (F.sqrt(var) + 1e-12))


def subpaths(df: DataFrame, n: int, stride: int = 1) -> DataFrame:
    """(series_id, sub_id, start_i, end_i, end_ts): windows of n rows, every ``stride`` rows; the tail that fills none is dropped."""
    ends = df.filter((F.col("i") >= n) & ((F.col("i") - n) % stride == 0))
    return ends.select("series_id", ((F.col("i") - n) / stride).cast("int").alias("sub_id"), (F.col("i") - n + 1).alias("start_i"), F.col("i").alias("end_i"), F.col("ts").alias("end_ts"))


def ensembles(subs: DataFrame, size: int, *, sliding: bool = True, short: str = "one") -> DataFrame:
    """(series_id, ensemble, first_sub, last_sub): ``size`` consecutive sub-paths, sliding by one or disjoint.

    A series of fewer sub-paths is one ensemble of them all (short = one), or none (short = none)."""
    n = F.max("sub_id").over(whole()) + 1
    s = subs.withColumn("_n", n)
    full = s.filter((F.col("sub_id") + size <= F.col("_n")) & (F.lit(sliding) | (F.col("sub_id") % size == 0)))
    full = full.select("series_id", (F.col("sub_id") if sliding else (F.col("sub_id") / size).cast("int")).alias("ensemble"), F.col("sub_id").alias("first_sub"), (F.col("sub_id") + size - 1).alias("last_sub"))
    if short != "one":
        return full
    few = s.filter((F.col("_n") < size) & (F.col("sub_id") == 0)).select("series_id", F.lit(0).alias("ensemble"), F.lit(0).alias("first_sub"), (F.col("_n") - 1).alias("last_sub"))
    return full.unionByName(few)


def iterated_sums(df: DataFrame, n: int, channels: tuple[str, ...] = ("t", "x"), level: int = 2) -> DataFrame:
    """Columns s_i, s_ij, s_ijk: strict iterated sums (levels 1 to 3) over the last n rows, null where fewer are there."""
    w = ordered()
    for c in channels:
        df = df.withColumn(f"_d_{c}", F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)))
        if level >= 2:
            df = df.withColumn(f"_l_{c}", F.lag(c).over(w))
    if level >= 2:
        for a, b in product(channels, repeat=2):
            df = df.withColumn(f"_p_{a}_{b}", F.sum(F.coalesce(F.col(f"_l_{a}") * F.col(f"_d_{b}"), F.lit(0.0))).over(expanding()))
    if level >= 3:
        for a, b, c in product(channels, repeat=3):
            df = df.withColumn(f"_q_{a}_{b}_{c}", F.sum(F.coalesce(F.lag(f"_p_{a}_{b}").over(w) * F.col(f"_d_{c}"), F.lit(0.0))).over(expanding()))
    back = lambda name: F.lag(name, n - 1).over(w)
    full = F.col("i") >= n
    step = lambda c: F.col(c) - back(c)
    second = lambda a, b: F.col(f"_p_{a}_{b}") - back(f"_p_{a}_{b}") - back(a) * step(b)
    for a in channels:
        df = df.withColumn(f"s_{a}", F.when(full, step(a)))
    if level >= 2:
        for a, b in product(channels, repeat=2):
            df = df.withColumn(f"s_{a}{b}", F.when(full, second(a, b)))
    if level >= 3:
        for a, b, c in product(channels, repeat=3):
            third = F.col(f"_q_{a}_{b}_{c}") - back(f"_q_{a}_{b}_{c}") - back(f"_p_{a}_{b}") * step(c) - back(a) * (F.col(f"_p_{b}_{c}") - back(f"_p_{b}_{c}") - back(b) * step(c))
            df = df.withColumn(f"s_{a}{b}{c}", F.when(full, third))
    return df.drop(*[c for c in df.columns if c.startswith(("_d_", "_l_", "_p_", "_q_"))])


def area_features(df: DataFrame, n: int, channels: tuple[str, ...] = ("t", "x"), level: int = 2) -> DataFrame:
    """Per disjoint block of n rows: 1, each channel's end less its start, its trapezoid area against the first channel, and at
    level 3 the sum of its absolute second differences (a cheap stand-in, no true signature)."""
    df = df.withColumn("block", F.floor((F.col("i") - 1) / n).cast("int"))
    w = ordered("series_id", "block")
    for c in channels:
        df = df.withColumn(f"_prev_{c}", F.lag(c).over(w)).withColumn(f"_prev2_{c}", F.lag(c, 2).over(w))
    aggs = [F.count("*").alias("_n"), F.min("i").alias("start_i"), F.max("i").alias("end_i"), F.max("ts").alias("end_ts"), F.lit(1.0).alias("level0")]
    clock = channels[0]
    for c in channels:
        aggs.append((F.max_by(c, "i") - F.min_by(c, "i")).alias(f"delta_{c}"))
        aggs.append(F.sum((F.col(c) + F.col(f"_prev_{c}")) / 2 * (F.col(clock) - F.col(f"_prev_{clock}"))).alias(f"area_{c}"))
        if level >= 3:
            aggs.append(F.sum(F.abs(F.col(c) - 2 * F.col(f"_prev_{c}") + F.col(f"_prev2_{c}"))).alias(f"rough_{c}"))
    return df.groupBy("series_id", "block").agg(*aggs).filter(F.col("_n") == n).drop("_n")


def power_signature(df: DataFrame, n: int, c: str = "ret", depth: int = 4, stride: int = 1) -> DataFrame:
    """sig_1 .. sig_depth of a one-dimensional window: the increment to the power k over k!; windows end every ``stride`` rows."""
    step = F.col(c) - F.lag(c, n - 1).over(ordered())
    for k in range(1, depth + 1):
        df = df.withColumn(f"sig_{k}", F.pow(step, F.lit(float(k))) / math.factorial(k))
    return df.filter((F.col("i") >= n) & ((F.col("i") - n) % stride == 0))


def absolute_products(df: DataFrame, n: int, channels: tuple[str, ...] = ("t", "x"), level: int = 2) -> DataFrame:
    """Levels 1 to 3 with absolute values, not taken from the window's start: sum of X_i dX_j, and of X_i X_j times the step
    after the next (non-standard, kept as the presets use it)."""
    w = ordered()
    inner = Window.partitionBy("series_id").orderBy("i").rowsBetween(-(n - 1), -1)
    inner2 = Window.partitionBy("series_id").orderBy("i").rowsBetween(-(n - 1), -2)
    full = F.col("i") >= n
    for a in channels:
        df = df.withColumn(f"a_{a}", F.when(full, F.col(a) - F.lag(a, n - 1).over(w)))
        df = df.withColumn(f"_n1_{a}", F.lead(a).over(w) - F.col(a)).withColumn(f"_n2_{a}", F.lead(a, 2).over(w) - F.lead(a).over(w))
    for a, b in product(channels, repeat=2):
        df = df.withColumn(f"_ab", F.col(a) * F.col(f"_n1_{b}")).withColumn(f"a_{a}{b}", F.when(full, F.sum("_ab").over(inner)))
    if level >= 3:
        for a, b, c in product(channels, repeat=3):
            df = df.withColumn("_abc", F.col(a) * F.col(b) * F.col(f"_n2_{c}")).withColumn(f"a_{a}{b}{c}", F.when(full, F.sum("_abc").over(inner2)))
    return df.drop("_ab", "_abc", *[c for c in df.columns if c.startswith(("_n1_", "_n2_"))])


def daily_outer(df: DataFrame, n: int = 20, channels: tuple[str, ...] = ("t", "x"), *, lag_day: bool = True, level: int = 2) -> DataFrame:
    """Per row: mean step and mean of running sum times step of the already differenced channels, over the window that ends
    the day before (lag_day) or the same day. Level 2 is weak (the step itself counts in the running sum)."""
    w = ordered().rowsBetween(-n, -1) if lag_day else rows(n)
    df = df.withColumn("_full", F.count("*").over(w) == n)
    for c in channels:
        frame = F.collect_list(c).over(w)
        df = df.withColumn(f"_f_{c}", F.when(F.col("_full"), frame))
        df = df.withColumn(f"_g_{c}", F.zip_with(F.slice(f"_f_{c}", 2, n), F.slice(f"_f_{c}", 1, n - 1), lambda b, a: b - a))
        df = df.withColumn(f"_h_{c}", F.zip_with(F.slice(f"_g_{c}", 2, n), F.slice(f"_g_{c}", 1, n - 2), lambda b, a: b - a))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    for c in channels:
        df = df.withColumn(f"o_{c}", add(F.col(f"_h_{c}")) / (n - 2))
    if level >= 2:
        for a, b in product(channels, repeat=2):
            total = F.aggregate(F.zip_with(f"_h_{a}", f"_h_{b}", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")),
                                lambda acc, v: F.struct((acc["c"] + v["x"]).alias("c"), (acc["s"] + (acc["c"] + v["x"]) * v["y"]).alias("s")))
            df = df.withColumn(f"o_{a}{b}", total["s"] / (n - 2))
    return df.drop("_full", *[c for c in df.columns if c.startswith(("_f_", "_g_", "_h_"))])


def standardized(df: DataFrame, columns: list[str], first: int | None = None) -> DataFrame:
    """Columns z-scored with the population deviation + 1e-12, over the series (looks ahead) or its first rows only."""
    for c in columns:
        x = F.col(c) if first is None else F.when(F.col("i") <= first, F.col(c))
        df = df.withColumn(c, (F.col(c) - F.avg(x).over(whole())) / (F.stddev_pop(x).over(whole()) + 1e-12))
    return df


def ensemble_mean(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Mean of each column over the ``size`` sub-paths up to the row."""
    for c in columns:
        df = df.withColumn(f"mean_{c}", F.when(F.count(c).over(rows(size)) == size, F.avg(c).over(rows(size))))
    return df
