"""Line dedup by site-relative frequency, in DataFrame functions only.

A host's boilerplate lines are those that more than ``ratio`` of its pages hold, two pages at least; they are dropped from its
pages. Lines compare after trimming ASCII white space; empty lines never count and stay. Pages of a host that hold the same
lines in the same order are one page in both counts: copies of a whole page are not furniture, and are for the near-duplicate
stage to judge.

Null texts stay null; they and empty ones are one page of their host together. A null host is a host of its own. Each of
repeated rows is rewritten. Columns of any name go along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stage


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\x0b\f"))


def _host(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _hashes(text: Column) -> Column:
    """Hashes of a page's distinct lines, in order of their first place."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _trim), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = 0.02) -> DataFrame:
    """(host, lines array<long>): hashes of each host's boilerplate lines; at most lines-per-page / ratio of them a host.

    Both steps count within their tasks before the shuffle: a page that a third of all rows copy costs one row a task, and so does
    a line that a third of all pages hold."""
    pages = docs.select(_host(F.col(host)).alias("host"), _hashes(F.col(text)).alias("lines")).distinct()
    pages = stage(pages, "pages")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter("n > 1")
    heavy = counts.join(totals, "host").filter(F.col("n") > ratio * F.col("pages"))
    return heavy.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def cleaned(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = 0.02, dropped: str | None = None) -> DataFrame:
    """``docs`` with ``text`` rewritten; with a name for ``dropped``, that column tells how many lines went. No row is removed."""
    heavy = sized(stage(boilerplate(docs, host=host, text=text, ratio=ratio), "boilerplate"), "lines")
    rows = docs.select(F.struct("*").alias("row"), _host(F.col(host)).alias("at"), F.col(text).alias("text"))
    out = rows.join(heavy, F.col("at") == F.col("host"), "left").select("row", "text", F.array_intersect(_hashes(F.col("text")), F.coalesce("lines", F.array().cast("array<bigint>"))).alias("hit"))
    lines = F.split("text", "\n")
    stays = lambda x: (_trim(x) == "") | ~F.array_contains("hit", F.xxhash64(_trim(x)))
    out = out.select("row", "text", F.when(F.size("hit") > 0, F.filter(lines, stays)).alias("kept"))
    new = {text: F.coalesce(F.array_join("kept", "\n"), F.col("text"))}
    if dropped:
        new[dropped] = F.when(F.col("kept").isNotNull(), F.size(lines) - F.size("kept")).otherwise(0)
    columns = [c for c in docs.columns if c not in new]
    got = {c: F.col("row").getField(c) for c in columns} | new
    return out.select(*[got[c].alias(c) for c in [*docs.columns, *([dropped] if dropped and dropped not in docs.columns else [])]])


def report(docs: DataFrame) -> DataFrame:
    out = cleaned(docs.select("doc_id", "source", "text"), dropped="n_dropped")
    return out.select("doc_id", F.col("n_dropped").cast("long").alias("n_dropped"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def oracle_sql(ratio: float = 0.02, docs: str = "documents") -> str:
    trim = "trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, text, string_split(text, chr(10)) AS lines FROM {docs}),
s AS (SELECT *, list_filter(list_transform(coalesce(lines, []), lambda x: {trim}), lambda x: x <> '') AS full_lines FROM d),
o AS (SELECT DISTINCT host, list_filter(full_lines, lambda x, i: list_position(full_lines, x) = i) AS full_lines FROM s),
n AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(full_lines) AS line FROM o) GROUP BY host, line),
p AS (SELECT host, count(*) AS pages FROM o GROUP BY host),
heavy AS (SELECT n.host, list(line) AS heavy FROM n JOIN p ON n.host = p.host WHERE n.n > 1 AND n.n > {ratio} * pages GROUP BY n.host),
k AS (SELECT d.*, list_filter(lines, lambda x: {trim} = '' OR NOT coalesce(list_contains(heavy, {trim}), false)) AS kept FROM d LEFT JOIN heavy ON d.host = heavy.host),
t AS (SELECT doc_id, coalesce(len(lines) - len(kept), 0) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k)
SELECT doc_id, n_dropped, length(text) AS n_chars, md5(text) AS text_md5 FROM t"""
