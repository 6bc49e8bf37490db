"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by multi-index hashing.

A fingerprint bit is 1 if it is set in over half of the shingles' XXH64 values. Two fingerprints link at ``radius`` or
fewer differing bits, and documents that reach each other over links form a component.

Null and empty texts, and texts without words, have fingerprint zero and link like any other. Texts of fewer words than
a shingle are one shingle. Equal fingerprints are handled once, whatever the number of documents that bear them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collide import SIMILAR, Words, classes, exact, joined, kept, mix, sequence_hash, with_both, within
from .common import map_arrow, sized, stage
from .graph import components

SEED = 42
#: Table buckets of more fingerprints are linked over shared ball centres, not pair by pair.
BUCKET = 64
_BITS = 4096
#: Segment buckets of at most so many texts are paired at once; larger ones are compared with a leader at a time.
PAIRED = 4
#: Segment keys of a partition.
RANGE = 1 << 20
#: Bits of a wide fingerprint, and hashes that are added up at once.
WIDE, _ROWS = 2048, 128
_COLUMNS = np.random.default_rng(3).integers(1, 2**63, WIDE // 8, dtype=np.uint64)
_LANES, _ODD = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, n: int = 3) -> int:
    """The SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, n words a shingle."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = [0, *(ends[:-n] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1:].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BITS):
        part = hashes[i:i + _BITS]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """(doc_id, fp long): one row a document row, in one pass without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t or b"", n) for t in b.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")), run, "doc_id long, fp long")


def _keys(fp: Column) -> Column:
    """(seg, key, probe) rows of a fingerprint for radius 2 over two 32-bit halves.

    Two bits in all leave the high half equal, or the low half equal, or one bit in each. So the ball of radius 1 around
    the high half and that of radius 0 around the low half find every pair. Of two high halves that differ in one bit,
    one has the bit set: only flips that clear a bit are enumerated, and each pair is met once."""
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.expr("0") != high.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    flips = F.transform(set_bits, lambda i: F.struct(F.lit(0).alias("seg"), high.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("key"), F.lit(True).alias("probe")))
    own = F.array(F.struct(F.lit(0).alias("seg"), high.alias("key"), F.lit(False).alias("probe")), F.struct(F.lit(1).alias("seg"), low.alias("key"), F.lit(False).alias("probe")))
    return F.concat(own, flips)


def links(prints: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """(src, dst): distinct fingerprints of at most 2 differing bits, complete up to reachability.

    Fingerprints are looked up in the tables of both halves. Keys with more than ``bucket`` table rows and probes would
    make pairs with the square of their number; the fingerprints under such a key are enumerated as whole balls of radius 1
    instead: two of them differ in at most 2 bits exactly if their balls share a centre, a centre has at most 65 of them,
    and each is linked to the centre's smallest. No candidate is dropped."""
    keyed = stage(prints.select("fp", F.explode(_keys(F.col("fp"))).alias("k")).select("fp", "k.seg", "k.key", "k.probe"), "keys")
    heavy = keyed.groupBy("seg", "key").agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("t")).filter((F.col("n") > bucket) & (F.col("t") > 0)).select("seg", "key")
    heavy = stage(heavy, "heavy")
    light = keyed.join(heavy, ["seg", "key"], "left_anti")
    # a key that one fingerprint bears has no pair: left out before the join
    shared = light.groupBy("seg", "key").agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("t"), F.collect_list(F.struct("probe", "fp")).alias("of")).filter((F.col("n") > 1) & (F.col("t") > 0))
    pairs = shared.select(F.explode("of").alias("a"), "of").filter(~F.col("a.probe")).select(F.col("a.fp").alias("a"), F.explode("of").alias("b"))
    pairs = pairs.filter(F.col("b.probe") | (F.col("b.fp") > F.col("a"))).select("a", F.col("b.fp").alias("b"))
    near = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    crowd = keyed.join(heavy, ["seg", "key"], "left_semi").select("fp").distinct()
    centres = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    balls = crowd.select("fp", F.explode(centres).alias("c")).groupBy("c").agg(F.collect_list("fp").alias("of")).filter(F.size("of") > 1)
    near_in_balls = balls.select(F.array_min("of").alias("src"), F.explode("of").alias("dst")).filter("src != dst")
    return near.unionByName(near_in_balls)


def clusters(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the smallest doc_id reachable over links, itself included.

    Rows that repeat a doc_id are kept each with its own fingerprint. Rows with a null doc_id keep null as component_id
    unless their fingerprint links them to others."""
    prints = stage(fingerprints(docs, doc_id=doc_id, text=text, n=n), "prints")
    unique = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "unique")
    roots = components(links(unique, bucket=bucket), "fps").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = unique.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(of, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return clusters(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _missed(width: int, segments: int, differ: float) -> float:
    """The probability that no segment of ``width`` sampled bits is equal, if each of the WIDE bits differs with ``differ``.

    Segments share bits, so they are independent only for a given number of differing ones; it is summed over that number."""
    k = np.arange(WIDE + 1)
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, WIDE + 1)))])
    chance = np.exp(factorial[WIDE] - factorial[k] - factorial[WIDE - k] + k * np.log(differ) + (WIDE - k) * np.log(1 - differ))
    free = np.maximum(WIDE - k - width, 0)
    equal = np.where(k + width <= WIDE, np.exp(factorial[WIDE - k] - factorial[free] - factorial[WIDE] + factorial[WIDE - width]), 0)
    return float((chance * (1 - equal) ** segments).sum())


def layout(n: int, similar: float = SIMILAR, recall: float = 0.99) -> tuple[int, int, int]:
    """(width of a segment, number of segments, most differing bits) of wide fingerprints for n texts.

    Sets of the Jaccard similarity s have a cosine of at least 2s / (1 + s), whatever edit made them differ: a block, a cut
    tail or scattered words. A bit of a SimHash over the five-word shingles differs with the probability of that cosine's
    angle over pi. Segments are wide enough that a text meets a few others by chance, however many there are, and
    so many that a pair at the similarity has an equal one with the wanted probability, which is the same for every n. The
    distance allowed for is four standard deviations above the mean at that similarity."""
    differ = float(np.arccos(2 * similar / (1 + similar)) / np.pi)
    width = min(60, max(20, int(np.ceil(np.log2(max(2, n)))) + 6))
    low, segments = 0, 1
    while _missed(width, segments, differ) > 1 - recall:
        low, segments = segments, segments * 2
    while segments - low > 1:
        middle = (low + segments) // 2
        low, segments = (low, middle) if _missed(width, middle, differ) <= 1 - recall else (middle, segments)
    return width, segments, int(WIDE * differ + 4 * np.sqrt(WIDE * differ * (1 - differ)))


def wide(shingles: np.ndarray) -> np.ndarray:
    """A SimHash of WIDE bits over distinct 64-bit hashes. A hash weighs in each bit with a byte of its own rather than a
    sign, so few hashes make no ties."""
    total = np.zeros((2, WIDE // 2), np.int64)
    own = shingles * _ODD
    for i in range(0, len(shingles), _ROWS):
        h = mix(mix(own[i:i + _ROWS], np.uint64(1))[:, None], _COLUMNS)
        for j in range(2):  # the bytes of a half are added up in 16 bits each
            total[j] += ((h >> np.uint64(8 * j)) & _LANES).sum(0, dtype=np.uint64).view(np.uint16)
    return (total * 2 > 255 * len(shingles)).reshape(-1)


def _wide_prints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, mark: hash of the text, unit: hash of the word sequence, bits binary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                b = whole.slice(begin, 500)
                words = Words([t or b"" for t in b.column(1).to_pylist()])
                first = np.array(words.first)
                n = np.diff(first)
                with np.errstate(over="ignore"):
                    units = sequence_hash(words.key, first[:-1], n)
                    h = words.shingles()
                    prints = [np.packbits(wide(words.shingle_set(h, a, k))).tobytes() for a, k in zip(first[:-1].tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(units.view(np.int64)), pa.array(prints, pa.binary())], ["doc_id", "mark", "unit", "bits"])

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    return map_arrow(base, run, "doc_id long, mark long, unit long, bits binary")


@lru_cache(maxsize=2)
def _drawn(width: int, segments: int) -> np.ndarray:
    return np.random.default_rng(7).random((segments, WIDE)).argpartition(width, axis=1)[:, :width].T.copy()


def segment_keys(bits: np.ndarray, width: int, segments: int) -> np.ndarray:
    """Per row of bits, a key of each segment: ``width`` bits drawn at random, the same for all rows."""
    value = np.zeros((len(bits), segments), np.uint64)
    for at in _drawn(width, segments):
        value = value << np.uint64(1) | bits[:, at]
    return mix(value, np.arange(1, segments + 1, dtype=np.uint64))


def _all_keys(bits: np.ndarray, width: int, segments: int) -> np.ndarray:
    """The segment keys of rows of packed bits, as signed numbers."""
    with np.errstate(over="ignore"):
        return segment_keys(np.unpackbits(bits, axis=1).astype(np.uint64), width, segments).view(np.int64)


def _keyed(units: DataFrame, width: int, segments: int) -> DataFrame:
    """(key, unit): a row for each segment of (unit, bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                b = whole.slice(begin, 500)
                bits = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                keys = _all_keys(bits, width, segments).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column(0).to_numpy(), segments))], ["key", "unit"])

    return map_arrow(units.select("unit", "bits"), run, "key long, unit long")


def _met(keyed: DataFrame, rows: int) -> DataFrame:
    """(a, b, null): the pairs of units that share a key of at most PAIRED units, and (unit, leader, key) for those under larger keys,
    where the leader is the smallest unit under the key.

    ``rows`` is the number of rows at most; partitions hold RANGE of them, so sorting takes little memory."""
    def met(key: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        size = count[inverse]
        large = size > PAIRED
        lead = np.full(len(count), 2**63 - 1)
        np.minimum.at(lead, inverse[large], unit[large])
        a, b = [], []
        for step in range(1, PAIRED):
            at = np.nonzero((key[step:] == key[:-step]) & (size[step:] <= PAIRED))[0]
            a.append(np.minimum(unit[at], unit[at + step]))
            b.append(np.maximum(unit[at], unit[at + step]))
        a, b = np.concatenate([*a, unit[large]]), np.concatenate([*b, lead[inverse[large]]])
        under = pa.concat_arrays([pa.nulls(len(b) - int(large.sum()), pa.int64()), pa.array(key[large])])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), under], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = unit = np.empty(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                key, unit = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([unit, batch.column(1).to_numpy()])
                whole = np.searchsorted(key, key[-1])  # the last key may go on in the next batch
                yield met(key[:whole], unit[:whole])
                key, unit = key[whole:], unit[whole:]
        yield met(key, unit)

    return map_arrow(keyed.repartition(max(1, -(-rows // RANGE)), "key").sortWithinPartitions("key"), run, "a long, b long, key long").distinct()


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, mark, class, least): groups of texts with a five-word-shingle Jaccard similarity of ``similar`` or more, over links.

    Multi-index hashing over wide fingerprints: texts that agree in a segment meet, their complete distance is verified, and
    what is left is verified by the exact similarity. All texts of a bucket of at most PAIRED are paired; larger buckets, which are
    groups of variants, are compared with a leader at a time, and then class against class (``collide.classes``), so no pair of
    different classes that shares a segment goes unseen. Texts of equal word sequences are one unit from the start. least is the
    smallest doc_id of the group, mark a hash of the row's text. Texts without words are copies of each other. Rows of null ids
    are grouped like others, but are no group's least unless it has no ids."""
    docs_ = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = docs_.count()
    width, segments, most = layout(n, similar)
    wide_prints = stage(_wide_prints(docs_, "doc_id", "text"), "wide")
    units = stage(wide_prints.groupBy("unit").agg(F.min("doc_id").alias("at"), F.min("bits").alias("bits"), F.count("*").alias("n")), "units")
    met = stage(_met(_keyed(units, width, segments), n * segments), "met")
    crowd, stars = met.filter("key is not null"), met.filter("key is not null and a <> b").select("a", "b").distinct()
    pairs = met.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = stage(kept(with_both(pairs, units, "bits"), within(most)), "near")
    wanted = near.select(F.col("a").alias("u")).unionByName(near.select(F.col("b").alias("u"))).unionByName(stars.select(F.col("a").alias("u"))).unionByName(stars.select(F.col("b").alias("u"))).distinct()
    sets = _sets(docs_, units, wanted).join(units.select(F.col("unit").alias("_unit"), F.col("bits").alias("sketch")), F.col("unit") == F.col("_unit")).drop("_unit")
    sets = stage(sets, "sets")
    links = stage(exact(near, sets, similar), "links")
    found = joined(links)
    # buckets whose units are all of their leader's class are done; the others go on with further leaders
    of = sized(found)
    side = lambda c: of.select(F.col("unit").alias(f"_{c}"), F.col("class").alias(f"of_{c}"))
    apart = stars.join(side("a"), F.col("a") == F.col("_a"), "left").join(side("b"), F.col("b") == F.col("_b"), "left")
    apart = stage(apart.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(F.col("a").alias("_a"), F.col("b").alias("_b")), "apart")
    if apart.limit(1).count():
        open_ = stage(crowd.join(sized(apart), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_semi").select(F.col("key").alias("_key")).distinct(), "open")
        buckets = stage(crowd.join(sized(open_), F.col("key") == F.col("_key"), "left_semi").select("key", F.col("a").alias("unit")), "buckets")
        # a pair is compared under its smallest shared key; above, keys of at most PAIRED units compared all pairs and others those of their smallest unit
        found = classes(sets, similar, buckets=buckets, linked=links, most=most, before=crowd.filter("a = b").count(), keys=partial(_all_keys, width=width, segments=segments))
    of = sized(found).withColumnsRenamed({"unit": "_unit", "class": "_class"})
    many = stage(units.join(of, F.col("unit") == F.col("_unit"), "left").select("unit", "at", "n", F.coalesce("_class", "unit").alias("class")), "many")
    least = sized(stage(many.groupBy("class").agg(F.min("at").alias("least"), F.sum("n").alias("n")).filter("n > 1").select(F.col("class").alias("_class"), "least"), "least"))
    of = sized(stage(many.join(least, F.col("class") == F.col("_class")).select(F.col("unit").alias("_unit"), "class", "least"), "of"))
    # a text that is alone is its own group; rows of the others find their group by a table of their units, small or dealt by unit
    out = wide_prints.select("doc_id", "mark", "unit").join(of, F.col("unit") == F.col("_unit"), "left")
    return out.select("doc_id", "mark", F.coalesce("class", "unit").alias("class"), F.when(F.col("_unit").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("least"))


def _sets(docs: DataFrame, units: DataFrame, wanted: DataFrame) -> DataFrame:
    """(unit, shingles) of the units ``wanted`` (u), from the first document of each."""
    at = stage(units.join(wanted, F.col("unit") == F.col("u")).select("unit", F.col("at").alias("_at")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                b = whole.slice(begin, 500)
                words = Words([t or b"" for t in b.column(1).to_pylist()])
                first = words.first
                with np.errstate(over="ignore"):
                    h = words.shingles()
                    own = sequence_hash(words.key, np.array(first[:-1]), np.diff(first)).view(np.int64).tolist()
                    sets = [words.shingle_set(h, a, z - a).tobytes() for a, z in zip(first, first[1:])]
                # a repeated id may stand for another text
                same = pa.array([x == y for x, y in zip(own, b.column(0).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(same), pa.array(sets, pa.binary()).filter(same)], ["unit", "shingles"])

    joined = docs.join(sized(at), F.col("doc_id").eqNullSafe(F.col("_at"))).select("unit", F.col("text").cast("binary").alias("text"))
    return map_arrow(joined, run, "unit long, shingles binary").groupBy("unit").agg(F.min("shingles").alias("shingles"))


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with the one row of each group of near copies whose id is the smallest; columns, whatever their names, as they are.

    Rows with a null id stay, as nothing tells which of them to keep; rows of one group that repeat the kept id all stay. A row whose id
    another row bears goes only for its own text."""
    found = near_copies(docs, doc_id=doc_id, text=text, similar=similar).filter(F.col("doc_id") != F.col("least"))
    gone = sized(stage(found.select(F.col("doc_id").alias("gone"), "mark").distinct(), "gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("of"))
    return rows.join(gone, (F.col("id") == F.col("gone")) & (F.col("of") == F.col("mark")), "left_anti").select("row.*")
