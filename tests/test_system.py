"""Readers, writers, streams, presets and the registered queries."""

from __future__ import annotations

import json
import math
import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import contract, windows
from tidemark.plans import presets
from tidemark.plans.queries import REGISTRY
from tidemark.series import segment_px, with_ordinal
from tidemark.sources import readers, synthetic, writers
from tidemark.streaming import detector

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_readers(spark, tmp_path):
    csv, parquet = str(tmp_path / "a.csv"), str(tmp_path / "a.parquet")
    (tmp_path / "a.csv").write_text("Date,Close,Volume\n2020-01-02,2.5,10\n2020-01-01,2.0,\n")
    got = [tuple(r) for r in readers.read_csv(spark, csv).orderBy("i").select("i", "close", "volume").collect()]
    assert got == [(1, 2.0, None), (2, 2.5, 10)]
    readers.read_csv(spark, csv).drop("i").write.parquet(parquet)
    assert readers.read_any(spark, parquet, csv).count() == readers.read_any(spark, str(tmp_path / "none.parquet"), csv).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_first(spark, [str(tmp_path / "x.csv")])
    assert synthetic.or_synthetic(spark, lambda: readers.read_first(spark, [str(tmp_path / "x.csv")]), 50).count() == 50
    (tmp_path / "t.csv").write_text("ticker\n^GSPC\n")
    assert readers.read_tickers(spark, str(tmp_path / "t.csv")).first()[0] == "^GSPC"


def test_benchmarks_join_on_dates(spark):
    a = synthetic.gbm_path(spark, 10, series=2)
    vix = synthetic.gbm_path(spark, 5).withColumn("series_id", F.lit("vix"))
    assert readers.with_benchmarks(a, vix=vix).filter("vix is not null").count() == 10
    assert readers.most_rows(a.unionByName(vix), 1).select("series_id").distinct().collect()[0][0] == "path0"


def test_writers_refuse_and_write(spark, tmp_path):
    df = synthetic.switching_path(spark, 200).withColumn("regime", F.floor(F.col("i") / 101).cast("int")).withColumn("confidence", F.lit(0.5))
    out = contract.to_output(df)
    meta = contract.metadata("test_run", "Test", "other", {0: "a", 1: "b"}, {"k": 2}, ["close"])
    path = str(tmp_path / "out")
    with pytest.raises(ValueError, match="regime_labels_map"):
        writers.write_regimes(out, path, {**meta, "regime_labels_map": {"0": "a", "7": "b"}})
    assert not os.path.exists(path)
    writers.write_regimes(out, path, meta, fixed_decimals=True)
    back = spark.read.option("header", True).csv(f"{path}/regimes")
    assert back.count() == 200 and back.first()["confidence"] == "0.5000" and back.agg(F.min("date")).first()[0] == "2000-01-03"
    assert open(f"{path}/metadata.json", "rb").read(1) == b"{" and json.load(open(f"{path}/metadata.json")) == meta
    assert readers.read_metadata(spark, f"{path}/metadata.json").first()["num_regimes"] == 2
    report = writers.text_report(spark.createDataFrame([("s", 0, 1, None, None, 5)], "series_id string, seg int, regime int, start_ts date, end_ts date, n_days int"), "Report")
    assert report.splitlines()[0] == "Report" and len(report.splitlines()) == 4


def test_synthetic_paths_do_not_depend_on_partitions(spark):
    a = [tuple(r) for r in synthetic.switching_path(spark, 300, p=0.05).orderBy("i").collect()]
    b = [tuple(r) for r in synthetic.switching_path(spark, 300, p=0.05).repartition(5).orderBy("i").collect()]
    assert a == b and len({r[4] for r in a} | {0}) >= 2


def _stream(spark, tmp_path, judge, cuts):
    start = datetime(2020, 1, 1)
    prices = [(s, start + timedelta(days=k), 100 + 10 * math.sin(k * 1.7) + (30 if k in (70, 90) else 0) + j) for j, s in enumerate("ab") for k in range(100)]
    src = tmp_path / "in"
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame([p for p in prices if lo <= (p[1] - start).days < hi], "series_id string, ts timestamp, close double").coalesce(1).write.parquet(str(src / f"{n}"))
    schema = "series_id string, ts timestamp, close double"
    for n in range(len(cuts) - 1):  # one micro-batch each, restarted from the checkpoint
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src / f"{n}")) if n == 0 and len(cuts) == 2 else spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
        query = detector.detect(stream, judge).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.createDataFrame(prices, schema), spark.read.parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path):
    prices, out = _stream(spark, tmp_path, detector.rolling_z(k=2.0), [0, 30, 31, 75, 100])
    batch = windows.log_return(with_ordinal(prices)).withColumn("score", F.abs("ret"))
    batch = windows.z_threshold(batch, "score", k=2.0).withColumn("is_change", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)))
    key = lambda df: sorted((r["series_id"], r["i"], round(r["threshold"] or 0, 9), r["is_change"]) for r in df.collect())
    assert key(out) == key(batch) and any(r["is_change"] for r in out.collect())


def test_stream_hours_drop_late_events(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [[("a", base + timedelta(minutes=m), float(m)) for m in (5, 50, 70)], [("a", base + timedelta(hours=9), 1.0)], [("a", base + timedelta(minutes=6), 99.0), ("a", base + timedelta(hours=20), 2.0)], [("a", base + timedelta(hours=30), 2.0)]]
    for n, r in enumerate(rows):
        spark.createDataFrame(r, "event_type string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema("event_type string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        query = detector.hourly_prices(stream).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r["ts"]: (r["close"], r["volume"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got[base] == (27.5, 2) and got[base + timedelta(hours=1)] == (70.0, 1)


@needs_data
@pytest.mark.parametrize("name", ["ensemble_zscore", "feature_kmeans", "moment_window"])
def test_presets_meet_the_contract(spark, name):
    out = contract.to_output(presets.run(name, segment_px(spark, SF).filter("series_id < 'C'")), label="label")
    contract.validate(out, max_gap=10_000, max_rate=0.5)


@needs_data
def test_queries_equal_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")

    def key(rows):
        return sorted((tuple(round(v, 5) if isinstance(v, float) else str(v) if hasattr(v, "year") else v for v in row) for row in rows), key=repr)

    for name in ("vol_tercile_regime", "returns", "segment_stats", "subpath_sig2", "mmd2_labels", "ladder_z", "stability_score", "walkforward_sharpe", "event_response"):
        query, sql = REGISTRY[name]
        df = query(spark, SF)
        columns = ", ".join(f'"{c}"' for c in df.columns)
        assert key(tuple(r) for r in df.collect()) == key(con.execute(f"select {columns} from ({sql})").fetchall()), name


def test_entry_lists_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(REGISTRY) > 60


@needs_data
def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
