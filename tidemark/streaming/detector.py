"""Causal change detection over a stream of prices: the same rows as the batch operators, whatever the micro-batches.

State of a series: the last price, its ordinal, and the last scores that the threshold looks at. Rows of a micro-batch are
ordered by time; a row that is not later than the series' last one has been judged already, or comes too late, and is
dropped, as a watermark would drop it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "series_id string, ts timestamp, i int, close double, score double, threshold double, is_change boolean"
STATE = "data string"


def rolling_z(history: int = 504, k: float = 3.0, at_least: int = 20) -> Callable[[list[float], float], tuple[float, bool, list[float]]]:
    """Mean + k population deviations of the last known scores, the present one included."""
    def judge(memory: list[float], score: float) -> tuple[float, bool, list[float]]:
        memory = [*memory, score][-history:]
        if len(memory) < at_least:
            return math.nan, False, memory
        x = np.array(memory)
        sd = float(x.std())
        limit = float(x.mean()) + (0.01 if sd < 1e-12 else k * sd)
        return limit, score > limit, memory

    return judge


def feedback_percentile(memory_size: int = 200, q: float = 0.95, at_least: int = 50) -> Callable[[list[float], float], tuple[float, bool, list[float]]]:
    """Quantile of the last scores that were no changes themselves."""
    def judge(memory: list[float], score: float) -> tuple[float, bool, list[float]]:
        limit = float(np.quantile(memory, q)) if len(memory) >= max(20, at_least) else math.nan
        change = limit == limit and score > limit
        return limit, change, memory if change else [*memory, score][-max(memory_size, at_least):]

    return judge


def trailing_quantile(memory_size: int = 200, q: float = 0.95, at_least: int = 10) -> Callable[[list[float], float], tuple[float, bool, list[float]]]:
    """Quantile of the positive ones among the scores before the present one."""
    def judge(memory: list[float], score: float) -> tuple[float, bool, list[float]]:
        known = [s for s in memory if s > 0]
        limit = float(np.quantile(known, q)) if len(known) >= at_least else math.nan
        return limit, limit == limit and score > limit, [*memory, score][-memory_size:]

    return judge


def detect(prices: DataFrame, judge: Callable[[list[float], float], tuple[float, bool, list[float]]] | None = None) -> DataFrame:
    """prices: a streaming (series_id, ts timestamp, close); scores are absolute log returns."""
    judge = judge or rolling_z()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        data = json.loads(state.get[0]) if state.exists else {"i": 0, "ts": None, "close": None, "memory": []}
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, close in zip(rows["ts"], rows["close"]):
            stamp = ts.isoformat()
            if data["ts"] is not None and stamp <= data["ts"]:
                continue
            data["i"] += 1
            score, limit, change = math.nan, math.nan, False
            if close == close and close > 0:
                if data["close"]:
                    score = abs(math.log(close / data["close"]))
                    limit, change, data["memory"] = judge(data["memory"], score)
                data["close"] = float(close)
            data["ts"] = stamp
            out.append((key[0], ts, data["i"], close, score, limit, change))
        state.update((json.dumps(data),))
        yield pd.DataFrame(out, columns=["series_id", "ts", "i", "close", "score", "threshold", "is_change"])

    found = prices.select("series_id", F.col("ts").cast("timestamp").alias("ts"), F.col("close").cast("double").alias("close")).groupBy("series_id").applyInPandasWithState(
        run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    blank = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select("series_id", "ts", "i", "close", blank("score"), blank("threshold"), "is_change")


def hourly_prices(events: DataFrame, *, late: str = "2 hours") -> DataFrame:
    """Mean value for each type of event and hour from a stream of events (ts, event_type, value); an hour is given out when the
    watermark has passed it, and events later than that are dropped."""
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    hours = stream.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.avg("value").alias("close"), F.count("*").alias("volume"))
    return hours.select(F.col("event_type").alias("series_id"), F.col("window.start").alias("ts"), "close", "volume")


def spike_sessions(changes: DataFrame, *, gap: str = "5 days", late: str = "1 day") -> DataFrame:
    """Changes of a series at most ``gap`` apart as one event (session windows)."""
    stream = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = stream.groupBy("series_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return found.select("series_id", F.col("session_window.start").alias("event_ts"), "n")
