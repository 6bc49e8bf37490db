"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

A document's inputs are its hashed words (logarithm of the count, unit norm) and its statistics, each as an indicator of
the training quantile that it falls in. The machine adds to the linear terms every pair's product weighted by the dot
product of two low-rank vectors; by the sum-of-squares identity that costs time linear in the number of inputs:
half of (sum of v x) squared minus the sum of (v x) squared, over the ranks.

The machine is fitted on a bounded sample of the labelled rows: those with the smallest hash of the id, ``max_rows`` at most
as many as have inputs of ``max_bytes`` together, none with inputs of over a fiftieth of that; all rows are scored over their whole texts. Ids, language, source and
labels are no inputs. Null texts count as empty; an empty text has a score like any other. Null labels and labels other than
0 and 1 teach nothing; without any label every score is 0.5. Of labels that repeat an id the smallest counts, of documents that
do the one with the smallest inputs teaches; each is scored. Columns of any name go along where rows are filtered.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, map_arrow, release, stage

WORDS, RANK, BINS = 1 << 14, 6, 16
_STATS = 18
_KNOWN = 200_000

_CLASS = np.full(256, 6, np.uint8)  # other ASCII signs
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[list(b".,;:'\"-()?")] = 4, 5, 7


def statistics(text: bytes, words: Counter, lines: list[bytes]) -> np.ndarray:
    n = max(1, len(text))
    kind = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8).astype(np.float64)
    total, letters = max(1, sum(words.values())), max(1.0, kind[0] + kind[1] + kind[3])
    top = words.most_common(2) if words else []
    signed = sum(c for w, c in words.items() if not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,;:"))
    full = [x for x in lines if x]
    return np.array([
        np.log1p(len(text)), np.log1p(total if words else 0), np.log1p(len(full)), kind[1] / letters, kind[2] / n, kind[3] / n, kind[4] / n, kind[5] / n, kind[6] / n, kind[7] / n,
        letters / total, len(words) / total, top[0][1] / total if top else 0.0, sum(c for _, c in top) / total, signed / total,
        1 - len(set(full)) / max(1, len(full)), total / max(1, len(full)), len(words) / np.sqrt(total),
    ])


def inputs(text: bytes, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their values, and the statistics."""
    low = text.lower()
    words = Counter(low.split())
    if len(known) > _KNOWN:
        known.clear()
    at = np.empty(len(words), np.int32)
    for i, w in enumerate(words):
        k = known.get(w)
        if k is None:
            k = known[w] = zlib.crc32(w) & (WORDS - 1)
        at[i] = k
    value = np.log1p(np.fromiter(words.values(), np.float64, len(words)))
    return at, (value / max(1e-9, np.sqrt(value @ value))).astype(np.float32), statistics(text, words, text.split(b"\n"))


@dataclass
class Machine:
    edges: np.ndarray  # statistics x (BINS - 1)
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, at: np.ndarray, value: np.ndarray, stats: np.ndarray) -> float:
        at, value = with_bins(at, value, stats, self.edges)
        vx = self.factor[at] * value[:, None]
        pairs = 0.5 * float((vx.sum(0) ** 2 - (vx ** 2).sum(0)).sum())
        z = self.bias + float(self.weight[at] @ value) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def with_bins(at: np.ndarray, value: np.ndarray, stats: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bins = (stats[:, None] > edges).sum(1) + WORDS + BINS * np.arange(len(stats))
    return np.concatenate([at, bins.astype(np.int32)]), np.concatenate([value, np.full(len(stats), 1 / np.sqrt(len(stats)) * 2, np.float32)])


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, *, epochs: int = 8, batch: int = 128, rate: float = 0.1, decay: float = 1e-6, seed: int = 7) -> Machine:
    """Logistic loss, mini-batches in a fixed random order, steps scaled by each weight's past gradients."""
    size = WORDS + BINS * _STATS
    rng = np.random.default_rng(seed)
    if not rows:
        return Machine(np.zeros((_STATS, BINS - 1)), 0.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))
    edges = np.quantile(np.stack([r[2] for r in rows]), np.arange(1, BINS) / BINS, axis=0).T
    data = [with_bins(*r, edges) for r in rows]
    share = np.clip(labels.mean(), 0.02, 0.98)
    bias, weight, factor = float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, RANK))
    past_w, past_v, past_b = np.full(size, 1e-4), np.full((size, RANK), 1e-4), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for s in range(0, len(order), batch):
            some = order[s:s + batch]
            at, x = (np.concatenate(c) for c in zip(*(data[i] for i in some)))
            row = np.repeat(np.arange(len(some)), [len(data[i][0]) for i in some])
            ends = np.searchsorted(row, np.arange(len(some)))
            vx = factor[at] * x[:, None]
            sums = np.add.reduceat(vx, ends)
            z = bias + np.add.reduceat(weight[at] * x, ends) + 0.5 * (sums ** 2 - np.add.reduceat(vx ** 2, ends)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
            e = (error[row] * x)
            used, inverse = np.unique(at, return_inverse=True)
            gw = np.bincount(inverse, e, len(used)) + decay * weight[used]
            gv = e[:, None] * (sums[row] - vx)
            gv = np.stack([np.bincount(inverse, gv[:, f], len(used)) for f in range(RANK)], 1) + decay * factor[used]
            past_w[used] += gw ** 2
            past_v[used] += gv ** 2
            past_b += error.sum() ** 2
            weight[used] -= rate * gw / np.sqrt(past_w[used])
            factor[used] -= rate * 0.5 * gv / np.sqrt(past_v[used])
            bias -= rate * error.sum() / np.sqrt(past_b)
    return Machine(edges, bias, weight.astype(np.float32), factor.astype(np.float32))


def _held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 12_000, max_bytes: int = 200_000_000) -> Machine:
    """Fit on rows of ``labels`` that are not held out (remainder 2 of crc32 modulo 4), ``max_rows`` and ``max_bytes`` at most.

    The chosen ids are bounded by ``max_rows``, so they are broadcast and the texts do not move. Their hashed inputs are staged, one
    row an id; the driver receives their sizes, then as many as fit ``max_bytes``, and never texts."""
    named = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~_held_out(F.col("id"), 4, 2))
    named = named.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text")).join(F.broadcast(named), F.col("doc") == F.col("id")).select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            rows = [inputs(t or b"", known) for t in b.column(2).to_pylist()]
            packs = [[r[i].tobytes() for r in rows] for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(p, pa.binary()) for p in packs)], ["id", "label", "at", "value", "stats"])

    hashed = map_arrow(chosen, run, "id long, label int, at binary, value binary, stats binary")
    hashed = hashed.groupBy("id", "label").agg(F.min(F.struct("at", "value", "stats")).alias("of")).select(F.xxhash64("id").alias("rank"), "id", "label", "of.*")
    size = F.octet_length("at") + F.octet_length("value") + F.octet_length("stats")
    hashed = stage(hashed, "inputs").filter(size <= max_bytes // 50)
    sizes = hashed.select("rank", "id", size.alias("n")).orderBy("rank", "id").collect()
    ends = np.cumsum([r["n"] for r in sizes], dtype=np.int64)
    fit_in = int(np.searchsorted(ends, max_bytes, "right"))
    if fit_in < len(sizes):
        last = sizes[fit_in - 1]
        hashed = hashed.filter(F.struct("rank", "id") <= F.struct(F.lit(last["rank"]), F.lit(last["id"])))
    got = sorted(hashed.collect(), key=lambda r: (r["rank"], r["id"]))
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32), np.frombuffer(r["stats"], np.float64)) for r in got]
    return fit(rows, np.array([r["label"] for r in got], np.float64))


def score_of(text: Column, machine: Machine, spark: SparkSession) -> Column:
    """The score as a column: one pass over whole texts; only the texts go to Python."""
    bounded(spark)
    shared = spark.sparkContext.broadcast(machine)  # of fixed size: WORDS and RANK

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, int] = {}
        for texts in batches:
            yield pa.array([shared.value.score(*inputs(t.as_py() or b"", known)) for t in texts], pa.float64())
        release()

    return score(text.cast("binary"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    machine = train(docs, labels)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_of(F.col("text"), machine, docs.sparkSession).alias("score"))
    return out.select("doc_id", _held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; their columns, whatever their names, as they are."""
    machine = train(docs, labels, text=text)
    rows = docs.select(F.struct("*").alias("row"), score_of(F.col(text), machine, docs.sparkSession).alias("score"))
    return rows.filter(F.col("score") >= threshold).select("row.*")
