"""The corpus pipeline: documents from classifier to packed sequences, each stage an operator of ``tidemark.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents; n_chars follows the text where a stage rewrites it. Null
texts are empty documents, null ids are kept where a stage cannot tell rows apart; further columns go along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fm_quality, line_freq, packing, simhash, winnow
from tidemark.llm.common import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, fitted on the labels, scores at 0.7 or more."""
    return fm_quality.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop each source's boilerplate lines; every document stays. n_chars follows where a text changed."""
    if "n_chars" not in docs.columns:
        return line_freq.cleaned(docs)
    kind = docs.schema["n_chars"].dataType
    both = docs.select(F.struct("*").alias("row"), "source", "text")
    out = line_freq.cleaned(both, dropped="dropped")
    n_chars = F.when(F.col("dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near copies the document with the smallest id.

    The production parameters of the stage are those of near-duplicate stages: five-word shingles."""
    return simhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share ten words in a row with a benchmark item."""
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens: one row a piece, with its place and its ids' digest."""
    return packing.report(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", sequences),
]

#: A fitted classifier and a tokenizer have no SQL; the stages' tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
