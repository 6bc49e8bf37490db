"""Runs of equal labels: segmentation, statistics, merging, renumbering, expansion back to days."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import expanding, ordered, whole


def numbered(df: DataFrame, label: str = "regime", out: str = "seg") -> DataFrame:
    """seg: number of the row's run of equal labels, from 0."""
    change = F.coalesce((F.col(label) != F.lag(label).over(ordered())).cast("int"), F.lit(0))
    return df.withColumn("_c", change).withColumn(out, F.sum("_c").over(expanding()).cast("int")).drop("_c")


def segments(df: DataFrame, label: str = "regime") -> DataFrame:
    """(series_id, seg, regime, start_ts, end_ts, n_days): the runs and how long they dwell."""
    out = numbered(df, label).groupBy("series_id", "seg").agg(F.min(label).alias("regime"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").cast("int").alias("n_days"))
    return out


def segment_stats(df: DataFrame, label: str = "regime", *, price: str = "close", ret: str = "ret") -> DataFrame:
    """Per run: mean and sample deviation of returns, Sharpe = mean / (deviation + 1e-12), largest drawdown, total return, days."""
    df = numbered(df, label)
    peak = F.max(price).over(expanding("series_id", "seg"))
    df = df.withColumn("_dd", F.col(price) / peak - 1)
    out = df.groupBy("series_id", "seg").agg(
        F.min(label).alias("regime"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").cast("int").alias("n_days"), F.avg(ret).alias("mean_ret"),
        F.stddev_samp(ret).alias("vol"), F.min("_dd").alias("max_dd"), (F.max_by(price, "i") / F.min_by(price, "i") - 1).alias("total_ret"))
    return out.withColumn("sharpe", F.col("mean_ret") / (F.col("vol") + 1e-12))


def from_changes(df: DataFrame, flag: str = "is_change", out: str = "regime") -> DataFrame:
    """A counter that goes up at each rising edge of the flag."""
    edge = (F.col(flag) & ~F.coalesce(F.lag(flag).over(ordered()), F.lit(False))).cast("int")
    return df.withColumn("_e", F.coalesce(edge, F.lit(0))).withColumn(out, F.sum("_e").over(expanding()).cast("int")).drop("_e")


def from_change_days(df: DataFrame, changes: DataFrame, *, step: int = 1, out: str = "regime") -> DataFrame:
    """Change points (series_id, cp) lie at day cp * step + 1; a day's regime is the number of change points up to it."""
    marks = changes.select("series_id", (F.col("cp") * step + 1).cast("int").alias("i"), F.lit(1).alias("_m")).distinct()
    return df.join(marks, ["series_id", "i"], "left").withColumn(out, F.coalesce(F.sum("_m").over(expanding()), F.lit(0)).cast("int")).drop("_m")


def relabeled(df: DataFrame, label: str = "regime", out: str = "regime") -> DataFrame:
    """Labels as 0, 1, 2 ... in their sorted order within the series."""
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy("series_id").orderBy(label)) - 1)


def _merge_regime(rows: list[list[int]], shortest: int) -> list[list[int]]:
    """The first short segment takes the neighbour regime of the greater total length (the left on a tie), again and again."""
    while True:
        short = next((k for k, r in enumerate(rows) if r[1] < shortest), None)
        if short is None or len(rows) < 2:
            return rows
        totals: dict[int, int] = {}
        for label, n in rows:
            totals[label] = totals.get(label, 0) + n
        left = rows[short - 1][0] if short else None
        right = rows[short + 1][0] if short + 1 < len(rows) else None
        rows[short][0] = right if left is None or (right is not None and totals[right] > totals[left]) else left
        rows = _joined(rows)


def _merge_neighbor(rows: list[list[int]], shortest: int) -> list[list[int]]:
    """The first short segment takes the longer neighbour segment, at an edge its only one; then from the start again."""
    while True:
        short = next((k for k, r in enumerate(rows) if r[1] < shortest), None)
        if short is None or len(rows) < 2:
            return rows
        if short == 0 or short == len(rows) - 1:
            other = 1 if short == 0 else short - 1
        else:
            other = short - 1 if rows[short - 1][1] >= rows[short + 1][1] else short + 1
        rows[short][0] = rows[other][0]
        rows = _joined(rows)


def _joined(rows: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for label, n in rows:
        if out and out[-1][0] == label:
            out[-1][1] += n
        else:
            out.append([label, n])
    return out


def _merge_smallest(rows: list[list[int]], most: int) -> list[list[int]]:
    """While over ``most`` labels are left, the label of fewest rows goes over to the label before it (after it, if first)."""
    while len({r[0] for r in rows}) > most:
        totals: dict[int, int] = {}
        for label, n in rows:
            totals[label] = totals.get(label, 0) + n
        least = min(totals, key=lambda label: (totals[label], label))
        at = next(k for k, r in enumerate(rows) if r[0] == least)
        target = rows[at - 1][0] if at else rows[at + 1][0]
        rows = _joined([[target if r[0] == least else r[0], r[1]] for r in rows])
    return rows


_POLICIES = {"regime": _merge_regime, "neighbor": _merge_neighbor, "smallest": _merge_smallest}


def merged(df: DataFrame, label: str = "regime", *, policy: str = "regime", limit: int = 15, out: str = "regime") -> DataFrame:
    """Merge short runs until none is left (policies regime and neighbor: runs under ``limit`` rows; smallest: over ``limit`` labels).

    The fixpoint runs on each series' table of runs, a few rows, and is joined back to its days."""
    merge = _POLICIES[policy]
    runs = numbered(df, label, "_seg").groupBy("series_id", "_seg").agg(F.min(label).alias("_label"), F.count("*").alias("_n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_seg")
        done = merge([[int(a), int(b)] for a, b in zip(rows["_label"], rows["_n"])], limit)
        labels = [label for label, n in done for _ in range(n)]
        ends = rows["_n"].cumsum().to_numpy() - 1
        return rows.assign(_label=[labels[e] for e in ends])[["series_id", "_seg", "_label"]]

    new = runs.groupBy("series_id").applyInPandas(run, "series_id string, _seg int, _label int")
    return numbered(df, label, "_seg").join(new, ["series_id", "_seg"]).withColumn(out, F.col("_label")).drop("_seg", "_label")


def equal_chunks(df: DataFrame, k: int, out: str = "regime") -> DataFrame:
    """k stretches of equal length (the fallback without change points)."""
    n = F.count("*").over(whole())
    return df.withColumn(out, F.least(F.floor((F.col("i") - 1) / F.greatest(F.floor(n / k), F.lit(1))), F.lit(k - 1)).cast("int"))


def ensemble_days(df: DataFrame, ensembles: DataFrame, value: str, *, span: int, dated: str = "start") -> DataFrame:
    """Give each day an ensemble's value. start: day j takes ensemble min(j, last) as it is written (looks ahead by ``span`` rows);
    end: the ensemble that ends on the day, as a causal detector would date it."""
    e = ensembles.select("series_id", F.col("ensemble").alias("_e"), value)
    if dated == "end":
        return df.withColumn("_e", F.col("i") - span).join(e, ["series_id", "_e"], "left").drop("_e")
    last = ensembles.groupBy("series_id").agg(F.max("ensemble").alias("_last"))
    return df.join(last, "series_id").withColumn("_e", F.least(F.col("i") - 1, F.col("_last"))).join(e, ["series_id", "_e"], "left").drop("_e", "_last")


def sampled_labels(df: DataFrame, label: str = "label", out: str = "regime") -> DataFrame:
    """A row takes the first sampled label at or after it; past the last sample the last one (looks ahead)."""
    after = F.first(label, ignorenulls=True).over(ordered().rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(after, F.last(label, ignorenulls=True).over(expanding())))


def overlap_stats(df: DataFrame, ensembles: DataFrame, *, span: int, label: str = "regime", ret: str = "ret") -> DataFrame:
    """Mean and population deviation of returns by regime where each ensemble adds its ``span`` days, repeats counted.

    How many ensembles of each regime cover a day comes from the ensembles' counts in the frame of ``span`` rows, so
    days are not multiplied."""
    cover = ensembles.select("series_id", (F.col("ensemble") + 1).alias("i"), F.col(label).alias("_label"))
    labels = [r[0] for r in cover.select("_label").distinct().orderBy("_label").collect()]
    base = df.join(cover, ["series_id", "i"], "left")
    w = ordered().rowsBetween(-(span - 1), 0)
    for v in labels:
        base = base.withColumn(f"_n{v}", F.sum((F.col("_label") == v).cast("int")).over(w))
    counted = base.select("series_id", ret, F.explode(F.array(*[F.struct(F.lit(v).alias("regime"), F.col(f"_n{v}").alias("n")) for v in labels])).alias("x"))
    weight: Column = F.col("x.n")
    sums = counted.filter((weight > 0) & F.col(ret).isNotNull()).groupBy("series_id", F.col("x.regime").alias("regime")).agg(F.sum(weight).alias("n"), F.sum(weight * F.col(ret)).alias("s"), F.sum(weight * F.col(ret) * F.col(ret)).alias("ss"))
    return sums.select("series_id", "regime", "n", (F.col("s") / F.col("n")).alias("mean_ret"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))).alias("vol"))
