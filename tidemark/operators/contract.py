"""The regime output contract: checks before a write, and the metadata beside it."""

from __future__ import annotations

import json
import re
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the contract.
VERSION = "1.0"
REQUIRED = ("date", "predicted_regime", "confidence", "transition_flag")
METADATA_KEYS = ("algorithm", "algorithm_full_name", "algorithm_family", "paper_reference", "num_regimes", "regime_labels_map", "parameters", "training_window_days", "features_used", "generated_at", "output_spec_version")
ALGORITHM = r"^[a-z][a-z0-9_]{1,31}$"
LABEL = r"^[A-Za-z0-9_]{1,32}$"


def to_output(df: DataFrame, *, regime: str = "regime", confidence: str = "confidence", label: str | None = None) -> DataFrame:
    """The contract's columns for one series: date, predicted_regime, confidence (4 decimals), transition_flag and any label."""
    w = Window.partitionBy("series_id").orderBy("i")
    flag = F.coalesce((F.col(regime) != F.lag(regime).over(w)).cast("int"), F.lit(0))
    columns = [F.col("ts").alias("date"), F.col(regime).cast("int").alias("predicted_regime"), F.bround(F.col(confidence), 4).alias("confidence"), flag.alias("transition_flag")]
    if label:
        columns.append(F.col(label).alias("regime_label"))
    columns += [F.col(c) for c in ("regime_return_forecast", "regime_vol_forecast") if c in df.columns]
    return df.select("series_id", *columns)


def checks(out: DataFrame, *, start: date | None = None, end: date | None = None, max_gap: int = 5, max_rate: float = 0.3, min_rows: int = 100) -> DataFrame:
    """(series_id, check, bad): one row a check and series, bad = number of violations, all from one aggregation."""
    w = Window.partitionBy("series_id").orderBy("date")
    out = out.withColumn("_gap", F.datediff("date", F.lag("date").over(w))).withColumn("_before", F.lag("predicted_regime").over(w))
    change = F.coalesce((F.col("predicted_regime") != F.col("_before")).cast("int"), F.lit(0))
    first = F.col("_gap").isNull()
    rules = {
        "date_missing": F.count_if(F.col("date").isNull()),
        "date_repeated": F.count_if(F.col("_gap") == 0),
        "date_gap": F.count_if(F.col("_gap") > max_gap),
        "before_start": F.count_if(F.col("date") < F.lit(start)) if start else F.lit(0),
        "after_end": F.count_if(F.col("date") > F.lit(end)) if end else F.lit(0),
        "regime_missing": F.count_if(F.col("predicted_regime").isNull()),
        "regime_negative": F.count_if(F.col("predicted_regime") < 0),
        "regime_gaps": F.max("predicted_regime") + 1 - F.countDistinct("predicted_regime"),
        "confidence_range": F.count_if(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1)),
        "confidence_decimals": F.count_if(F.abs(F.col("confidence") * 10000 - F.round(F.col("confidence") * 10000)) > 1e-6),
        "flag_values": F.count_if(F.col("transition_flag").isNull() | ~F.col("transition_flag").isin(0, 1)),
        "first_flag": F.count_if(first & (F.col("transition_flag") != 0)),
        "flag_is_change": F.count_if(F.col("transition_flag") != change),
        "transition_rate": (F.avg("transition_flag") > max_rate).cast("int"),
        "few_rows": (F.count("*") < min_rows).cast("int"),
    }
    if "regime_label" in out.columns:
        rules["label_charset"] = F.count_if(~F.col("regime_label").rlike(LABEL))
    found = out.groupBy("series_id").agg(*[v.cast("long").alias(k) for k, v in rules.items()])
    return found.select("series_id", F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(k, F.lit(0).cast("long")).alias("bad")) for k in rules])).alias("c")).select("series_id", "c.*")


def metadata(algorithm: str, full_name: str, family: str, labels: dict[int, str], parameters: dict, features: list[str], *, paper: str | None = None, training_days: int | None = None) -> dict:
    return {
        "algorithm": algorithm, "algorithm_full_name": full_name, "algorithm_family": family, "paper_reference": paper, "num_regimes": len(labels),
        "regime_labels_map": {str(k): v for k, v in sorted(labels.items())}, "parameters": parameters, "training_window_days": training_days, "features_used": features,
        "generated_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "output_spec_version": VERSION,
    }


def metadata_problems(meta: dict, regimes: set[int] | None = None) -> list[str]:
    """What is wrong with a run's metadata; further keys are allowed."""
    bad = [f"missing {k}" for k in METADATA_KEYS if k not in meta]
    if bad:
        return bad
    if not re.match(ALGORITHM, str(meta["algorithm"])):
        bad.append("algorithm name")
    if not isinstance(meta["num_regimes"], int) or not 1 <= meta["num_regimes"] <= 20:
        bad.append("num_regimes out of 1 to 20")
    labels = meta["regime_labels_map"]
    if len(labels) != meta["num_regimes"]:
        bad.append("num_regimes and regime_labels_map differ")
    if regimes is not None and {str(r) for r in regimes} != set(labels):
        bad.append("regime_labels_map and the regimes differ")
    bad += [f"label {v!r}" for v in labels.values() if not re.match(LABEL, str(v))]
    if meta["output_spec_version"] != VERSION:
        bad.append("output_spec_version")
    return bad


def validate(out: DataFrame, meta: dict | None = None, **limits) -> None:
    """Raise before anything is written if the output or its metadata break the contract."""
    missing = [c for c in REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    bad = [f"{r['series_id']}: {r['check']} ({r['bad']})" for r in checks(out, **limits).filter("bad > 0").limit(50).collect()]
    if meta is not None:
        bad += metadata_problems(meta, {r[0] for r in out.select("predicted_regime").distinct().limit(21).collect()})
    if bad:
        raise ValueError("; ".join(bad))


def metadata_json(meta: dict) -> str:
    return json.dumps(meta, indent=2, ensure_ascii=False)
