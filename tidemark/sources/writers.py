"""Writers of regime output, metadata and reports. The contract is checked before anything is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.contract import metadata_json, validate


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One text file through Hadoop's file system, UTF-8 without a byte-order mark."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_regimes(out: DataFrame, path: str, meta: dict, *, fixed_decimals: bool = False, repair: bool = False, **limits) -> None:
    """``path``/{series_id}/part*.csv with a header, \\n line ends and yyyy-MM-dd dates, and metadata.json; raises on a broken contract.

    A series is written by one task, ordered by date. fixed_decimals writes confidence with four digits always; repair sets the
    transition flags right before the contract is checked."""
    out = repaired(out) if repair else out
    validate(out, meta, **limits)
    rows = out.withColumn("confidence", F.format_string("%.4f", "confidence")) if fixed_decimals else out
    (rows.repartition("series_id").sortWithinPartitions("series_id", "date").write.partitionBy("series_id").mode("overwrite")
     .option("header", True).option("lineSep", "\n").option("dateFormat", "yyyy-MM-dd").csv(f"{path}/regimes"))
    write_text(out.sparkSession, f"{path}/metadata.json", metadata_json(meta))


def repaired(out: DataFrame) -> DataFrame:
    """``out`` with transition flags that mark exactly the changes of predicted_regime, the first row of a series 0: the one
    breach that is mended instead of refused."""
    by = Window.partitionBy("series_id").orderBy("date")
    change = F.coalesce((F.col("predicted_regime") != F.lag("predicted_regime").over(by)).cast("int"), F.lit(0))
    return out.withColumn("transition_flag", change.cast(out.schema["transition_flag"].dataType))


def text_report(segments: DataFrame, title: str) -> str:
    """A fixed-width table of all segments, drawn from the executors partition by partition."""
    lines = [title, "=" * len(title), f"{'series':<16}{'seg':>5}{'regime':>8}  {'start':<12}{'end':<12}{'days':>6}"]
    for r in segments.orderBy("series_id", "seg").toLocalIterator():
        lines.append(f"{r['series_id']:<16}{r['seg']:>5}{r['regime']:>8}  {r['start_ts']!s:<12}{r['end_ts']!s:<12}{r['n_days']:>6}")
    return "\n".join(lines) + "\n"


def plot_data(df: DataFrame, *, score: str = "score", threshold: str = "threshold", flag: str = "is_change") -> DataFrame:
    """(series_id, ts, kind, value): the price, score and threshold lines and the change marks of a chart, as one table."""
    kinds = {"price": F.col("close"), "score": F.col(score), "threshold": F.col(threshold), "change": F.when(F.col(flag), F.col("close"))}
    points = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("double").alias("value")) for k, c in kinds.items()])
    return df.select("series_id", "ts", F.explode(points).alias("p")).select("series_id", "ts", "p.kind", "p.value").filter(F.col("value").isNotNull())
