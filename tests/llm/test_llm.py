"""Each operator against a brute-force version on documents with every awkward case, and on empty tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tidemark.llm import backoff_lm, entries, fm_quality, graph, hnsw, line_freq, packing, para_dedup, simhash, url_rank, winnow, wrappers

from .helpers import alnum, documents, frame, roots, split, text

DOCS = "doc_id long, text string, source string"


def by_key(rows, *keys):
    out = defaultdict(list)
    for row in rows:
        out[tuple(row[k] for k in keys)].append(tuple(row))
    return {k: sorted(v, key=repr) for k, v in out.items()}


# ---- 1 url verdicts ------------------------------------------------------------------------------------------------
PAGES = [
    (1, "http://a.example.com/en/7x", "<a href='http://B.example.org/x'>x</a>"), (2, "https://a.example.com/en/8", None), (3, "HTTP://X.NET/de/1?q#f", ""), (4, "http://example.net/de/8", "<A class=k HREF=//a.example.com/>"),
    (5, "no scheme", "x"), (6, None, None), (6, None, None), (7, "http://b.example.org/es/1", "<a href=\"http://spam.example.io/\">"), (8, "http://b.example.org/en/1", "<a href='/own'>"), (9, "http://spam.example.io/", "<a href='http://b.example.org/'>"),
    (10, "http://notexample.com/en/7", ""), (11, "http://com/en/", ""), (12, "x://q.org?/es/", ""), (13, "http://b.example.org/es/2", "<a href='https://spam.example.io:80/z'>"),
]


def test_op1_rules_and_sql(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rank.report(pages).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block")
    assert got[3] == ("x.net", "/de/1", "net/de/", "allow")
    assert got[4][2:] == ("example.net/de/8", "block")
    assert got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None)
    assert got[10][2] == "com/en/" and got[11][2] == "com/en/" and got[12][:3] == ("q.org", "", None)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = con.execute(f"select {', '.join(cols)} from ({url_rank.oracle_sql()})").fetchall()
    assert sorted(want, key=repr) == sorted((tuple(r) for r in url_rank.report(pages).select(cols).collect()), key=repr)


def test_op1_trust_flows_along_links_and_distrust_against(spark):
    hosts = spark.createDataFrame([("good", 1.0, 0.0), ("mid", 0.0, 0.0), ("bad", 0.0, 1.0), ("linker", 0.0, 0.0)], "host string, trust_seed double, distrust_seed double")
    links = spark.createDataFrame([("good", "mid", 1.0), ("linker", "bad", 1.0)], "src string, dst string, weight double")
    got = {r["host"]: r for r in url_rank.host_scores(hosts, links).collect()}
    assert got["mid"]["trust"] == pytest.approx(0.85) and got["mid"]["distrust"] == 0
    assert got["linker"]["distrust"] == pytest.approx(0.85) and got["linker"]["trust"] == 0


# ---- 2 nearest neighbours ------------------------------------------------------------------------------------------
def test_op2_recall_and_invalid_vectors(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(500, 8)), np.repeat(rng.normal(size=(1, 8)), 40, 0), rng.normal(size=(60, 8)) * 1e-3])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [0.0] * 6), (1100, [float("nan")] + [1.0] * 7), (1200, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (1300, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    graphs, shards = hnsw.index(df, shard=150)
    got = defaultdict(list)
    for r in hnsw.search(graphs, shards, df.filter("vec_id % 20 = 0"), block=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert shards > 1 and 1100 not in got and 1200 not in got and 1300 not in got  # alone in its dimension
    hit = total = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        hit += len(set(order) & {i for i, _ in got[q]})
        total += 10
        assert [s for _, s in got[q]] == sorted(s for _, s in got[q]) and len(got[q]) == 10
        assert all(s == pytest.approx(d[i]) for i, s in got[q])
    assert hit / total >= 0.9
    assert hnsw.report(df.limit(0)).count() == 0
    assert hnsw.report(df.filter("vec_id = 0")).count() == 0


# ---- 3 quality -----------------------------------------------------------------------------------------------------
def test_op3_learns_and_scores_everything(spark):
    good = [(i, text(i, 80), "a") for i in range(300)]
    bad = [(i, " ".join(w + "###" for w in text(i, 80).split()), "a") for i in range(300, 500)]
    docs = frame(spark, good + bad + [(900, None, "a"), (901, "", None), (901, "", None), (None, "x", "b")], DOCS)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(500)] + [(1, None, 0), (None, 1, 1), (2, 7, 0)], "doc_id long, quality int, toxic int")
    rows = fm_quality.report(docs, labels).collect()
    assert len(rows) == 504 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 500 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows if r["doc_id"] is not None)
    assert sum(r["predicted"] == (r["doc_id"] < 300) for r in held) / len(held) > 0.97
    assert {r["predicted"] for r in rows} == {0, 1} and all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    kept = fm_quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id < 300").count() >= 290
    empty = fm_quality.report(docs, labels.limit(0)).collect()
    assert {r["score"] for r in empty} == {0.5}
    assert fm_quality.report(docs.limit(0), labels).count() == 0


def test_op3_pair_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    size = fm_quality.WORDS + fm_quality.BINS * fm_quality._STATS
    m = fm_quality.Machine(np.zeros((fm_quality._STATS, fm_quality.BINS - 1)), 0.1, rng.normal(size=size), rng.normal(size=(size, 3)) * 0.1)
    at, value, stats = fm_quality.inputs(b"some words here some", {})
    i, x = fm_quality.with_bins(at, value, stats, m.edges)
    z = m.bias + (m.weight[i] * x).sum() + sum(m.factor[i[a]] @ m.factor[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
    assert m.score(at, value, stats) == pytest.approx(1 / (1 + math.exp(-z)))


# ---- 4 packing -----------------------------------------------------------------------------------------------------
def test_op4_ids_places_and_count(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    docs = frame(spark, documents() + [(300, "a  b \n\n c <|endoftext|> don't I'LL", "x"), (302, "<|endoftext|><|endoftext|> x<|endoftext", "x"), (301, "ab" * 4000, "x")], DOCS)
    rows = packing.report(docs).collect()
    want = Counter()
    for d, t, *_ in docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1
    assert packing.report(docs.limit(0)).count() == 0


def test_op4_plan_equals_placing_one_by_one():
    rng = np.random.default_rng(3)
    for size in (10, 64):
        counts = Counter(rng.integers(1, size + 1, 300).tolist())
        rooms: list[int] = []
        for length in sorted(counts.elements(), reverse=True):
            fit = min((room, k) for k, room in enumerate(rooms) if room >= length)[1] if any(room >= length for room in rooms) else None
            if fit is None:
                rooms.append(size - length)
            else:
                rooms[fit] -= length
        steps = packing.plan(dict(counts), size)
        assert int((steps[:, 3]).max()) < len(rooms)
        used = Counter()
        for length, rank in ((n, k) for n in counts for k in range(counts[n])):
            mine = steps[steps[:, 0] == length]
            s = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
            used[int(s[3] + (rank - s[1]) // s[2])] += length
        assert sorted(used.values()) == sorted(size - room for room in rooms)


def test_op4_sequences_hold_the_ids(spark):
    docs = frame(spark)
    made = packing.sequences(docs, capacity=512).collect()
    total = sum(len(r["ids"]) // 4 for r in made)
    pieces = packing.tokenized(docs, capacity=512)
    assert total == pieces.selectExpr("sum(length)").first()[0] and max(len(r["ids"]) for r in made) <= 4 * 512


# ---- 5 extraction --------------------------------------------------------------------------------------------------
def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


CASES = [
    (page("<nav><ul><li><a href='/a'>A</a></li></ul></nav><div class='ad'>Buy</div><article><h1>Head  line</h1><p><b>One &amp; two<br><p>Three&#33;</p></article><footer>&copy; x</footer>"), "Head line One & two Three!"),
    (page("<article><p>Kept</p><section class='comments'><article>Reader</article></section><aside>Side</aside><form>Send<input></form></article><div id='cookie-notice'>Cookies</div>"), "Kept"),
    (page("<header>Site</header><main><p>a <i>b</i>c</p><div>d</div></main><!-- <p>no</p> -->"), "a bc d"),
    ("<article><p>cut off &lt;here", "cut off <here"),
    ("", ""), (None, ""),
    (page("<nav><ul><li>m<article><p>in an open menu</p></article>"), "in an open menu"),
    ("<article><p>x < y and 3<4</p></article>", "x < y and 3<4"),
    ("<article><p title='a > b'>quoted</p><noscript>no</noscript></article>", "quoted"),
]


def test_op5_cases(spark):
    rows = [(i, f"http://h{i}.example.com/", h) for i, (h, _) in enumerate(CASES)] + [(50, None, CASES[0][0]), (50, None, CASES[0][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS place")
    got = wrappers.report(df).collect()
    for i, (_, want) in enumerate(CASES):
        found = [r for r in got if r["page_id"] == i]
        assert [r["text"] for r in found] == [want] and found[0]["n_chars"] == len(want)
    assert [r["text"] for r in got if r["page_id"] == 50] == [CASES[0][1]] * 2
    assert wrappers.report(df.limit(0)).count() == 0


def test_op5_wrapper_and_place_without_article(spark):
    one = "<body><div class='menu'>x</div><div class='story'><p>{}</p><p>{}</p></div></body>"
    two = "<body><div class='menu'>x</div><div class='story'><h2>t</h2><p>{}</p></div></body>"
    rows = [(i, "http://h.example.com/", (one if i % 2 else two).format(text(i, 30), text(i + 50, 30))) for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = wrappers.wrappers(df).first()
    assert "(<p>#</>)+" in found["wrapper"] and "(<h2>#</>)?" in found["wrapper"] and found["place"] == "/div"
    got = {r["page_id"]: r["text"] for r in wrappers.report(df).collect()}
    assert all("x" != got[i].split()[0] for i in got) and got[1].startswith(" ".join(text(1, 30).split())[:40])


def test_op5_template_text_is_told_from_data(spark):
    body = "<article><p class='x'>{}</p><h2>Read this first</h2><ul><li>Same</li><li>On every page</li></ul><p>{}</p></article>"
    rows = [(i, "http://h.example.com/", page(body.format(text(i, 30), text(i + 50, 30)))) for i in range(6)]
    rows += [(10 + i, "http://k.example.com/", page(body.format("one", "copy"))) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in wrappers.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == " ".join((text(i, 30) + " " + text(i + 50, 30)).split()) for i in range(6))
    assert all(got[10 + i] == "one Read this first Same On every page copy" for i in range(4))


# ---- 6 decontamination ---------------------------------------------------------------------------------------------
def _items():
    long = split(text(1, 150))
    return [("i1", " ".join(long[20:45])), ("i2", "one"), ("i3", ""), ("i4", None), ("i5", text(4000, 40)), ("i6", " ".join(split(text(2, 60))[3:8])), ("i7", "ab"), ("i7", "ab"), ("i8", " ".join(split(text(9, 6000))[5000:5010]))]


@pytest.mark.parametrize("limit", [50_000, 3])
def test_op6_equals_brute_force(spark, limit):
    docs = frame(spark)
    items = spark.createDataFrame(_items(), "item_id string, text string").selectExpr("*", "1 AS kind")
    windows = defaultdict(set)
    for name, t in _items():
        w = alnum(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i:i + 10])].add(name)
    want = []
    for d, t, *_ in documents():
        w, hit, names = alnum(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    names |= found
        want.append((d, len(w), len(hit), sorted(names)))
    got = []
    for r in winnow.contamination(docs, items, set_limit=limit).collect():
        got.append((r["doc_id"], r["n_words"], len({p for s in r["spans"] for p in range(s["start"], s["end"])}), r["items"]))
    if limit > 3:
        assert sorted(got, key=repr) == sorted(want, key=repr)
        digest = {r["doc_id"]: r for r in winnow.report(docs, items).collect()}
        assert digest[1]["items_sha256"] == hashlib.sha256(b"i1").hexdigest() and digest[1]["contaminated"] and not digest[5]["contaminated"]
    else:
        assert sorted(got, key=repr) == sorted(want, key=repr)
    cleaned = winnow.clean(docs, items)
    bad = {w[0] for w in want if w[2]}
    assert cleaned.columns == docs.columns and cleaned.count() == sum(1 for d, *_ in documents() if d not in bad)


def test_op6_empty_tables(spark):
    docs, items = frame(spark), spark.createDataFrame([], "item_id string, text string")
    assert {r["n_hit"] for r in winnow.report(docs, items).collect()} == {0}
    assert winnow.report(docs.limit(0), items).count() == 0


# ---- 7 passages ----------------------------------------------------------------------------------------------------
def test_op7_finds_passages_and_spares_others(spark):
    passage = " ".join(split(text(70, 55)))
    rows = [(i, text(500 + i, 120, 30), "a") for i in range(12)]
    rows += [(20, "intro words " + passage + " and more " + text(600, 30), "a"), (21, text(601, 40, 40).replace("\n", " ") + " " + passage, "a")]
    near = split(text(80, 60, 60))
    rows += [(30, " ".join(near), "a"), (31, " ".join(near[:20] + ["edited"] + near[21:]), "b"), (32, None, "a"), (33, "", "a"), (None, passage, "a"), (34, text(90, 40, 40) + "\n" + text(90, 40, 40), "a")]
    got = para_dedup.report(frame(spark, rows, DOCS)).collect()
    assert {r["doc_id"] for r in got} == {20, 21, 30, 31}
    assert {r["doc_id"] for r in got if not r["removed"]} == {20, 30} and all(r["first_doc_id"] in (20, 30) for r in got)
    assert para_dedup.report(frame(spark, rows, DOCS).limit(0)).count() == 0
    assert para_dedup.report(frame(spark, rows[:3], DOCS)).count() == 0


# ---- 8 lines -------------------------------------------------------------------------------------------------------
def test_op8_equals_sql_and_spares_copies(spark):
    rows = [(i, text(i, 30) + "\nshared footer \n\n" + ("rare" if i < 3 else text(900 + i, 10)), "a") for i in range(40)] + [(100 + i, text(77, 60), "c") for i in range(30)] + documents()
    docs = frame(spark, rows, DOCS)
    got = {r["doc_id"]: r for r in line_freq.report(docs).collect()}
    assert got[5]["n_dropped"] == 0 and got[20]["n_dropped"] == 1 and got[110]["n_dropped"] == 0
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    want = con.execute(f"select doc_id, n_dropped, n_chars, text_md5 from ({line_freq.oracle_sql()})").fetchall()
    assert sorted(want, key=repr) == sorted((tuple(r) for r in line_freq.report(docs).select("doc_id", "n_dropped", "n_chars", "text_md5").collect()), key=repr)
    cleaned = line_freq.cleaned(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert line_freq.cleaned(docs, dropped="n").columns == [*docs.columns, "n"]
    assert line_freq.report(docs.limit(0)).count() == 0


# ---- 9 language model ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("order", [2, 3, 4])
def test_op9_equals_a_dictionary_model(spark, monkeypatch, order):
    monkeypatch.setattr(backoff_lm, "BATCH", 500)
    rows = documents()
    docs = [(d, [*(w.encode() for w in split(t)), b"\n"]) for d, t, *_ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs]
    grams = [Counter() for _ in range(order + 1)]
    for (_, w), out in zip(docs, held):
        if not out:
            for n in range(1, order + 1):
                grams[n].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    total, types, once = sum(grams[1].values()), len(grams[1]), sum(c == 1 for c in grams[1].values())
    unknown, mu = (once + 0.5) / (total + 1), 5.0

    def p(w, i, n):
        if n == 1:
            c = grams[1][w[i],]
            return c / total * (1 - unknown) if c else unknown
        lower = p(w, i, n - 1)
        if i < n - 1:
            return lower
        return (grams[n][tuple(w[i - n + 1:i + 1])] + mu * lower) / (grams[n - 1][tuple(w[i - n + 1:i])] + mu)

    got = by_key(backoff_lm.scores(frame(spark), order=order, mu=mu).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect(), "doc_id", "n_tokens")
    seen = Counter()
    for (d, w), out in zip(docs, held):
        row = got[d, len(w)][seen[d, len(w)]]
        seen[d, len(w)] += 1
        assert row[1] == out and row[3] == sum(grams[1][x,] > 0 for x in w) and row[4] == total
        assert row[5] == pytest.approx(sum(math.log10((grams[1][x,] + 0.1) / (total + 0.1 * (types + 1))) for x in w))
        assert row[6] == pytest.approx(sum(math.log10(p(w, i, order)) for i in range(len(w))), rel=1e-6)
    assert backoff_lm.report(frame(spark).limit(0)).count() == 0


# ---- 10 SimHash ----------------------------------------------------------------------------------------------------
def _fingerprint(t):
    w = split(t)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [64, 1])
def test_op10_fingerprints_and_links(spark, bucket):
    rng = np.random.default_rng(2)
    prints = {0, (1 << 64) - 1, *(int(v) for v in rng.integers(0, 1 << 62, 60))}
    for v in list(prints)[:30]:
        for _ in range(6):
            v ^= 1 << int(rng.integers(64))
            prints.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(prints)]
    near = [(a, b) for a in range(len(signed)) for b in range(a) if ((signed[a] ^ signed[b]) & ((1 << 64) - 1)).bit_count() <= 2]
    found = graph.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket=bucket))
    got = {r["node"]: r["component"] for r in found.collect()}
    want = roots(len(signed), near)
    groups = defaultdict(set)
    for v, root in zip(signed, want):
        groups[root].add(v)
    assert {v: got.get(v, v) for v in signed} == {v: min(g) for g in groups.values() for v in g}


def test_op10_report(spark):
    docs = frame(spark)
    rows = simhash.report(docs).collect()
    texts = documents()
    prints = [_fingerprint(t) for _, t, *_ in texts]
    want = roots(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    least = {}
    for (d, *_), root in zip(texts, want):
        if d is not None:
            least[root] = min(d, least.get(root, d))
    expected = sorted(((d, f"{f:016x}", least.get(root)) for (d, *_), f, root in zip(texts, prints, want)), key=repr)
    assert sorted((tuple(r) for r in rows), key=repr) == expected
    assert simhash.report(docs.limit(0)).count() == 0


def test_op10_near_copies(spark):
    docs = frame(spark)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(4) == 2 and ids.count(None) == 1
    assert set(range(100, 125)) <= set(ids) and 5 in ids and 6 not in ids and 7 not in ids
    assert simhash.representatives(docs.limit(0)).count() == 0


def _block_edits() -> list[tuple]:
    """Pairs 2k, 2k + 1 of 300 words: a replaced block, a cut tail or an added paragraph, at a Jaccard similarity of 0.80 to 0.85."""
    rows = []
    for k in range(45):
        words, other = split(text(3000 + k, 300)), split(text(6000 + k, 80))
        at, n = 20 + 5 * k, (28, 24, 26)[k // 3 % 3]
        near = [words[:at] + other[:n] + words[at + n:], words[:241 + k // 3 % 3 * 4], words[:at] + other[:56 + k // 3 % 3 * 4] + words[at:]][k % 3]
        rows += [(2 * k, " ".join(words), "a"), (2 * k + 1, " ".join(near), "a")]
    return rows


@pytest.mark.parametrize("n", [100_000, 30_000_000])
def test_op10_block_edits_at_any_number_of_rows(spark, monkeypatch, n):
    rows = _block_edits()
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (split(t) for _, t, _ in rows)]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(want) == 45 and all(b == a + 1 for a, b in want)
    planned = simhash.layout
    monkeypatch.setattr(simhash, "layout", lambda _, similar: planned(n, similar))
    found = {(r["least"], r["doc_id"]) for r in simhash.near_copies(frame(spark, rows, DOCS)).collect() if r["least"] != r["doc_id"]}
    assert found <= want and len(found) >= 0.97 * len(want)


@pytest.mark.parametrize("n", [100_000, 30_000_000])
def test_op10_segments_reach_the_recall_they_are_counted_for(n):
    rng = np.random.default_rng(4)
    width, segments, most = simhash.layout(n)
    sets = rng.integers(0, 2**63, (200, 297), dtype=np.uint64)
    near = sets.copy()
    near[:, :33] = rng.integers(0, 2**63, (200, 33), dtype=np.uint64)  # a replaced block: 264 of 330 in common
    with np.errstate(over="ignore"):
        a, b = (np.array([simhash.wide(x) for x in y]) for y in (sets, near))
        met = (simhash.segment_keys(a.astype(np.uint64), width, segments) == simhash.segment_keys(b.astype(np.uint64), width, segments)).any(1)
    assert met.mean() >= 0.97 and ((a != b).sum(1) <= most).all()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5), (None, 3), (7, 8), (7, 8)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 400)}}


# ---- registration --------------------------------------------------------------------------------------------------
def test_every_operator_is_registered():
    names = entries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(entries.oracle_sql()) <= set(names)
