"""Substring dedup: paragraphs by MinHash banding, and passages inside or across paragraphs by content-anchored windows.

A paragraph is a line of at least ``MIN_WORDS`` words. Its set of five-word shingles gets ``BANDS`` x ``ROWS`` minima,
and each band of ``ROWS`` of them is a bucket; at a similarity of 0.8 a pair shares a bucket with a probability of 1 - (1 -
0.8^3)^9 = 0.998. Paragraphs that collide with another get finer bands, colliding ones are verified by
exact Jaccard of their shingle sets, verified links make components, and of a component the paragraphs of the smallest doc_id
stay. A passage that is copied into the middle of another paragraph makes the paragraphs
dissimilar; so windows of ``SPAN`` words are units as well, starting at anchors that depend on the words alone (the smallest hash of
each ``ANCHOR`` consecutive three-word grams), which are alike only if equal. Any passage of SPAN + ANCHOR words that
two documents share holds a common window.

Words are those between ASCII white space, A-Z lower-cased; they and their sequences are told apart by 64-bit hashes.
Equal paragraphs are one row before banding, and a bucket's paragraphs are compared with one leader at a time and only across
components, so copies of any number make no pairs of their own. Null and empty texts have no paragraphs. Repetition
within one document is not reported. Rows that repeat a doc_id count as one document. Rows with a null id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .collide import SHINGLE, SIMILAR, Words, classes, mix, paired, sequence_hash, shifted, sketched
from .common import map_arrow, sized, stage

MIN_WORDS = 20
BANDS, ROWS = 9, 3
SPAN, ANCHOR = 32, 16
_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _sliding(h: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over h[i : i + width], width a power of two."""
    step = 1
    while step < width:
        h = pick(h, np.concatenate([h[step:], np.full(min(step, len(h)), fill, np.uint64)]))
        step *= 2
    return h


class Passages(Words):
    """Words with the windows that may be shared inside or across paragraphs."""

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors whose window ends within the text, and the windows' hashes."""
        n = len(self.key)
        first = np.array(self.first)
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words from here to the text's end
        two = paired(self.key, 1)
        gram = mix(two, shifted(self.key, 2)) | np.uint64(1)
        low = _sliding(gram, ANCHOR, np.minimum, 2**64 - 1)
        low[left < ANCHOR + 2] = 0  # grams of the window must end within the text
        high = _sliding(low[::-1], ANCHOR, np.maximum, 0)[::-1]
        at = np.nonzero((high == gram) & (left >= SPAN))[0]
        h, step = self.key, 1
        while step < SPAN:
            h = paired(h, step)
            step *= 2
        return at, h[at]


def _units(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(kind, unit, doc_id, line, start, n, bands): kind 0 paragraphs, kind 1 windows; start in words."""
    schema = pa.schema([("kind", pa.int32()), ("unit", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                b = whole.slice(begin, 500)
                ids, words = b.column(0).to_numpy(), Passages([t or b"" for t in b.column(1).to_pylist()])
                with np.errstate(over="ignore"):
                    yield from _rows(ids, words)

    def _rows(ids: np.ndarray, words: Passages) -> Iterator[pa.RecordBatch]:
        first = np.array(words.first)
        at, hashes = words.windows()
        text_of = np.searchsorted(first, at, "right") - 1
        none = pa.array([None] * len(at), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(hashes.view(np.int64)), pa.array(ids[text_of]), pa.array(np.full(len(at), -1, np.int32)), pa.array((at - first[text_of]).astype(np.int32)), pa.array(np.full(len(at), SPAN, np.int32)), none], schema=schema)
        lines = np.array([x for x in words.lines if x[3] >= MIN_WORDS], np.int64).reshape(-1, 4)
        if not len(lines):
            return
        counts = lines[:, 3] - SHINGLE + 1
        ends = np.cumsum(counts)
        places = np.repeat(lines[:, 2] - (ends - counts), counts) + np.arange(ends[-1])
        h = words.shingles()[places]
        starts = ends - counts
        minima = [np.minimum.reduceat((h * f + s) ^ ((h * f + s) >> np.uint64(32)), starts) for f, s in zip(_FACTORS, _SHIFTS)]
        bands = []
        for i in range(BANDS):
            key = np.full(len(lines), i + 1, np.uint64)
            for m in minima[i * ROWS:(i + 1) * ROWS]:
                key = mix(key, m)
            bands.append(key)
        unit = sequence_hash(words.key, lines[:, 2], lines[:, 3])
        flat = pa.array(np.stack(bands, 1).reshape(-1).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(lines) + 1, BANDS, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(lines), np.int32)), pa.array(unit.view(np.int64)), pa.array(ids[lines[:, 0]]), pa.array(lines[:, 1].astype(np.int32)), pa.array((lines[:, 2] - first[lines[:, 0]]).astype(np.int32)), pa.array(lines[:, 3].astype(np.int32)), lists], schema=schema)

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return map_arrow(base, run, "kind int, unit long, doc_id long, line int, start int, n int, bands array<long>")


def _sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(unit, shingles binary): the sorted distinct shingle hashes of wanted (unit, doc_id, line), from the documents that hold them."""
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "unit")).alias("lines")).withColumnRenamed("doc_id", "_id")
    by_doc = stage(by_doc, "wanted")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).join(sized(by_doc, "lines"), F.col("doc_id") == F.col("_id")).select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                b = whole.slice(begin, 500)
                words = Passages([t or b"" for t in b.column(0).to_pylist()])
                where = {(k, j): (a, n) for k, j, a, n in words.lines}
                units, sets = [], []
                with np.errstate(over="ignore"):
                    h = words.shingles()
                for k, lines in enumerate(b.column(1).to_pylist()):
                    for x in lines:
                        if found := where.get((k, x["line"])):
                            units.append(x["unit"])
                            sets.append(words.shingle_set(h, *found).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(sets, pa.binary())], ["unit", "shingles"])

    return map_arrow(base, run, "unit long, shingles binary").groupBy("unit").agg(F.min("shingles").alias("shingles"))


def _classes(units: DataFrame, docs: DataFrame, doc_id: str, text: str, similar: float) -> DataFrame:
    """(unit, class) of the distinct paragraphs that are linked to another; the rest are classes of their own."""
    distinct = units.filter("kind = 0").groupBy("unit").agg(F.min("bands").alias("bands"), F.min(F.struct("doc_id", "line")).alias("at"))
    keyed = distinct.select("unit", "at", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("key").alias("_key"))
    buckets = stage(keyed.join(shared, F.col("key") == F.col("_key")).select("key", "unit", "at"), "buckets")
    sets = _sets(docs, doc_id, text, buckets.select("unit", "at.doc_id", "at.line").distinct())
    found = classes(stage(sketched(sets), "sets"), similar)
    return found if found is not None else buckets.select("unit", F.col("unit").alias("class")).limit(0)


def passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, start, n_words, first_doc_id, copies, removed): the repeated stretches of each document, in words.

    Overlapping units with the same fate are one stretch. first_doc_id is the smallest document that holds one of its
    units, copies the most occurrences of one of them; a stretch is removed unless its document is the first."""
    units = stage(_units(docs, doc_id, text), "units")
    classes = _classes(units, docs, doc_id, text, similar).withColumnRenamed("unit", "_unit")
    paragraphs = units.filter("kind = 0").join(classes, F.col("unit") == F.col("_unit"), "left").select(F.lit(0).alias("kind"), F.coalesce("class", "unit").alias("unit"), "doc_id", "start", "n")
    alike = paragraphs.unionByName(units.filter("kind = 1").select("kind", "unit", "doc_id", "start", "n"))
    counted = alike.groupBy("kind", "unit").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("copies")).filter("first <> last")
    counted = stage(counted.select(F.col("kind").alias("_kind"), F.col("unit").alias("_unit"), "first", "copies"), "repeated")
    found = alike.join(sized(counted), (F.col("kind") == F.col("_kind")) & (F.col("unit") == F.col("_unit"))).select("doc_id", "start", (F.col("start") + F.col("n")).alias("end"), "first", "copies", (F.col("doc_id") != F.col("first")).alias("removed"))
    by = Window.partitionBy("doc_id", "removed").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("stretch", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = found.groupBy("doc_id", "removed", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first_doc_id"), F.max("copies").alias("copies"))
    return out.select("doc_id", F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), "first_doc_id", "copies", "removed")


def report(docs: DataFrame) -> DataFrame:
    return passages(docs)
