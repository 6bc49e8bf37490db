"""Benchmark decontamination by winnowing, in DataFrame functions only.

Fingerprints are hashes of k consecutive words; of every ``span - k + 1`` consecutive fingerprints the smallest is kept,
so two texts that share ``span`` words in a row keep a common fingerprint. The fingerprints of both sides are joined and
each hit is extended over the words around it: a window of ``span`` words counts only if its words are equal one by one.
Benchmark items of fewer than ``span`` words are one window each and are looked up by the hash of the whole item.

Null and empty texts have no words and are never hit. Ties of a window's smallest hash are all kept. Null ids are kept, and
repeated rows are judged one by one; columns beside the id and the text, whatever their names, are ignored or go along.
"""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, sized, stage

#: Fixed value: what separates words, after A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: So many benchmark fingerprints at most are held as a set in the plan at a time; more take further passes.
SET_LIMIT = 50_000
K = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _gram(words: str, n: int) -> Column:
    """Per position the hash of n words, null where fewer are left."""
    w = F.col(words)
    return F.transform(w, lambda x, i: F.when(F.get(w, i + (n - 1)).isNotNull(), F.xxhash64(x, *[F.get(w, i + j) for j in range(1, n)])))


def _least(grams: Column, start: Column, width: int) -> Column:
    """The smallest hash of the window at start; null if the window leaves the text."""
    inside = [F.when(start >= 0, F.get(grams, start + j)) for j in range(width)]
    full = inside[0].isNotNull() & inside[-1].isNotNull()
    return F.when(full, F.least(*inside) if width > 1 else inside[0])


def _chosen(grams: Column, i: Column, width: int) -> Column:
    """Whether position i holds the smallest hash of a window of ``width`` hashes around it."""
    h = F.get(grams, i)
    test = F.lit(False)
    for back in range(width):
        test = test | F.coalesce(_least(grams, i - back, width) == h, F.lit(False))
    return test


def item_prints(items: DataFrame, item_id: str, text: str, span: int, k: int) -> DataFrame:
    """(item_id, iw words, q position in them, kind, h): the chosen k-word fingerprints of items of at least ``span`` words (kind 0)
    with the words that a window over them can hold, one hash of the whole item of shorter ones (kind: their number of words)."""
    before = span - k
    base = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("iw")).filter(F.size("iw") > 0)
    long = base.filter(F.size("iw") >= span).withColumn("ig", _gram("iw", k))
    places = F.filter(F.sequence(F.lit(0), F.size("iw") - k), lambda i: _chosen(F.col("ig"), i, span - k + 1))
    long = long.select("item_id", "iw", "ig", F.explode(places).alias("at")).withColumn("from", F.greatest(F.lit(0), F.col("at") - before))
    long = long.select("item_id", F.slice("iw", F.col("from") + 1, F.lit(before + span)).alias("iw"), (F.col("at") - F.col("from")).alias("q"), F.lit(0).alias("kind"), F.get("ig", F.col("at")).alias("h"))
    short = base.filter(F.size("iw") < span).select("item_id", "iw", F.lit(0).alias("q"), F.size("iw").alias("kind"), F.xxhash64(*[F.get("iw", F.lit(j)) for j in range(span - 1)]).alias("h"))
    return long.unionByName(short)


def _matches(kind: int, hashes: list[int], span: int, k: int) -> Column:
    """Positions of the words ``w`` whose fingerprint is one of ``hashes``, each with the words that a window over it can hold."""
    w, before = F.col("w"), span - k
    if kind:
        grams = _gram("w", kind)
        at = F.filter(F.transform(grams, lambda h, i: F.struct(i.alias("p"), h.alias("h"))), lambda x: x["h"].isin(hashes))
        return F.transform(at, lambda x: F.struct(x["p"].alias("p"), x["h"].alias("h"), F.lit(kind).alias("kind"), x["p"].alias("c0"), F.slice(w, x["p"] + 1, F.lit(kind)).alias("ctx")))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.get("g", i).isin(hashes) & _chosen(F.col("g"), i, span - k + 1))
    made = F.transform(places, lambda i: F.struct(i.alias("p"), F.get("g", i).alias("h"), F.lit(0).alias("kind"), F.greatest(F.lit(0), i - before).alias("c0"),
                                                  F.slice(w, F.greatest(F.lit(0), i - before) + 1, F.lit(before + span)).alias("ctx")))
    return F.when(F.size("w") >= span, made)


def _extended(hits: DataFrame, span: int, k: int) -> DataFrame:
    """Grow each hit to both sides while the words are equal; keep runs of ``span`` words, or the whole of a shorter item."""
    before = span - k
    same = lambda j: F.coalesce(F.get("ctx", F.col("p") + j - F.col("c0")) == F.get("iw", F.col("q") + j), F.lit(False))
    flags = lambda js: F.concat(F.lit(""), *[F.when(same(F.lit(j)), "1").otherwise("0") for j in js])
    left = F.when(F.col("kind") == 0, F.length(F.regexp_extract(flags(range(-before, 0)), "1*$", 0))).otherwise(0)
    right = F.length(F.regexp_extract(flags(range(span)), "^1*", 0))
    hits = hits.withColumn("left", left).withColumn("right", right)
    whole = F.when(F.col("kind") == 0, F.col("left") + F.col("right") >= span).otherwise(F.col("right") == F.col("kind"))
    return hits.withColumn("span", F.when(whole, F.struct((F.col("p") - F.col("left")).alias("start"), (F.col("p") + F.col("right")).alias("end"))))


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  span: int = 10, k: int = K, set_limit: int = SET_LIMIT) -> DataFrame:
    """Per document row: (doc_id, n_words, spans array<struct<start, end>> of hit words, items sorted array<string>).

    The benchmark's fingerprints are the one side that is held in memory: they are counted first and taken in blocks of
    ``set_limit`` at most, each block one pass over the documents in which only matching positions leave the scan. A block's rows, each
    with 15 words of its item at most, are broadcast if they are few enough (many items may share a fingerprint) and joined by a
    shuffle otherwise. The documents' fingerprints are never gathered; the last shuffle brings the few hits of a document together."""
    prints = item_prints(items, item_id, item_text, span, k)
    prints = stage(prints, "prints")
    keys = (tuple(r) for r in prints.select("kind", "h").distinct().orderBy("kind", "h").toLocalIterator())
    spans = None
    block, following = list(islice(keys, set_limit)), list(islice(keys, set_limit))
    several = bool(following)
    rows_ = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows_ = stage(rows_, "rows") if several else rows_  # every pass must number the rows alike
    base = rows_.select("_row", "doc_id", words_of(F.col("text")).alias("w")).withColumn("g", _gram("w", k))
    while block or spans is None:
        kinds = sorted({kind for kind, _ in block})
        found = [F.coalesce(_matches(n, [h for m, h in block if m == n], span, k), F.array()) for n in kinds]
        rows = base.select("_row", "doc_id", F.size("w").alias("n_words"), (F.concat(*found) if found else F.lit(None).cast(
            "array<struct<p:int,h:bigint,kind:int,c0:int,ctx:array<string>>>")).alias("hits"))
        rows = rows.select("_row", "doc_id", "n_words", F.explode_outer("hits").alias("x")).select("_row", "doc_id", "n_words", "x.*")
        side = prints.withColumnRenamed("kind", "_kind").withColumnRenamed("h", "_h")
        if block:
            side = side.filter(F.struct("_kind", "_h").between(F.struct(F.lit(block[0][0]), F.lit(block[0][1])), F.struct(F.lit(block[-1][0]), F.lit(block[-1][1]))))
        rows = rows.join(sized(side), (F.col("kind") == F.col("_kind")) & (F.col("h") == F.col("_h")), "left")
        part = _extended(rows, span, k).select("_row", "doc_id", "n_words", "span", F.when(F.col("span").isNotNull(), F.col("item_id")).alias("item_id"))
        part = stage(part, "spans") if several else part  # the driver holds two blocks at most, and a plan one
        spans = part if spans is None else spans.unionByName(part)
        block, following = following, list(islice(keys, set_limit))
    out = spans.groupBy("_row", "doc_id", "n_words").agg(F.collect_set("span").alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    return out.select("doc_id", "n_words", F.sort_array("spans").alias("spans"), "items")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of ``contamination``: n_hit counts each hit word once."""
    found = contamination(docs, items)
    words = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(words).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that share a window with an item; their columns, whatever their names, stay as they are.

    Rows are told apart by their id and two hashes of their text, so that of rows with one id, or none, only those with a hit go."""
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))
    found = contamination(docs.select(key.alias("key"), F.col(text).alias("text")), items, doc_id="key", text="text")
    hit = sized(stage(found.filter(F.size("spans") > 0).select("doc_id.*").distinct(), "hit"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return rows.join(hit, (F.col("key.a") == F.col("a")) & (F.col("key.b") == F.col("b")) & F.col("key.id").eqNullSafe(F.col("id")), "left_anti").select("row.*")
