"""The queries of this subpackage, as ``__spark_entry__.py`` registers them, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backoff_lm, fm_quality, hnsw, line_freq, packing, para_dedup, simhash, url_rank, winnow, wrappers
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_rank": lambda s, d: url_rank.report(table(s, d, "pages")),
        "op2_hnsw": lambda s, d: hnsw.report(table(s, d, "embeddings")),
        "op3_factorisation_machine": lambda s, d: fm_quality.report(table(s, d, "documents"), table(s, d, "labels")),
        "op4_best_fit": lambda s, d: packing.report(table(s, d, "documents")),
        "op5_wrappers": lambda s, d: wrappers.report(table(s, d, "pages")),
        "op6_winnowing": lambda s, d: winnow.report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op7_paragraph_minhash": lambda s, d: para_dedup.report(table(s, d, "documents")),
        "op8_line_frequency": lambda s, d: line_freq.report(table(s, d, "documents")),
        "op9_backoff_automaton": lambda s, d: backoff_lm.report(table(s, d, "documents")),
        "op10_simhash": lambda s, d: simhash.report(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_rank": url_rank.oracle_sql(),
        "op8_line_frequency": line_freq.oracle_sql(),
    }
