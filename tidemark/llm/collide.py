"""Classes of similar units from buckets of colliding ones, without pairs within a bucket; word keys and exact Jaccard."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, sized, stage
from .graph import components

#: Rounds that compare a bucket with one leader, before all that are still apart in it are compared.
STARS = 4
#: Units of a bucket that a task compares among themselves; buckets so small are compared whole, before the last round too.
BLOCK, FEW = 1024, 32
SHINGLE, SIMILAR = 5, 0.8
FINE_BANDS, FINE_ROWS = 70, 12
_FACTORS = np.random.default_rng(5).integers(1, 2**63, FINE_BANDS * FINE_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes, in that order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shifted(h: np.ndarray, step: int) -> np.ndarray:
    return np.concatenate([h[step:], np.zeros(min(step, len(h)), np.uint64)])


def paired(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of more words, from those at i and i + step; the last ones are of fewer and must not be used."""
    return mix(h, shifted(h, step))


class Words:
    """The words of many texts, one after the other, as 64-bit keys, with the ends of texts and of lines.

    A-Z are lower-cased, words stand between ASCII white space; lines: (text, line, first word, number of words)."""

    def __init__(self, texts: list[bytes]) -> None:
        place: dict = defaultdict()
        place.default_factory = place.__len__
        tokens, self.lines, self.first = [], [], []
        at = 0
        for k, t in enumerate(texts):
            self.first.append(at)
            for j, line in enumerate(t.lower().split(b"\n")):
                words = line.split()
                if words:
                    tokens.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
                    self.lines.append((k, j, at, len(words)))
                    at += len(words)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, place), np.uint64, len(place))
        self.key = keys[np.concatenate(tokens)] if tokens else np.empty(0, np.uint64)
        self.first.append(at)

    def shingles(self) -> np.ndarray:
        """Hash of the SHINGLE words from each place on."""
        return mix(paired(paired(self.key, 1), 2), shifted(self.key, SHINGLE - 1))

    def shingle_set(self, shingles: np.ndarray, start: int, n: int) -> np.ndarray:
        """Sorted distinct hashes of a stretch's shingles; of fewer words than a shingle, the one of them all."""
        if n >= SHINGLE:
            return np.unique(shingles[start:start + n - SHINGLE + 1])
        return sequence_hash(self.key, np.array([start]), np.array([n])) if n else np.empty(0, np.uint64)


def sequence_hash(key: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of whole stretches of words: each word's key with its place, added up, with the number of words."""
    out = np.zeros(len(n), np.uint64)
    full = np.nonzero(n)[0]
    if len(full):
        n_full = n[full]
        begin = np.cumsum(n_full) - n_full
        place = np.arange(n_full.sum()) - np.repeat(begin, n_full)
        spots = np.repeat(start[full], n_full) + place
        out[full] = np.add.reduceat(mix(key[spots], place.astype(np.uint64)), begin)
    return mix(out, n.astype(np.uint64))


def sketched(sets: DataFrame) -> DataFrame:
    """(unit, shingles, sketch, keys) of (unit, shingles): MinHash bands of FINE_ROWS, and one bit of each minimum.

    At a similarity of 0.8 two sets share one of the FINE_BANDS bands with a probability of 0.993, at 0.6 with 0.14, at 0.5 with
    0.02; so buckets of variants of one text stay small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketches, keys = [], []
            with np.errstate(over="ignore"):
                for x in b.column(1):
                    h = np.frombuffer(x.as_py(), np.uint64)
                    low = np.full(FINE_BANDS * FINE_ROWS, 2**64 - 1, np.uint64)
                    for i in range(0, len(h), 512):
                        wide = h[i:i + 512, None] * _FACTORS
                        low = np.minimum(low, (wide ^ (wide >> np.uint64(32))).min(0))
                    sketches.append(np.packbits(((low * _ODD) >> np.uint64(63)).astype(np.uint8)).tobytes())
                    key = np.arange(1, FINE_BANDS + 1, dtype=np.uint64)
                    for column in low.reshape(FINE_BANDS, FINE_ROWS).T:
                        key = mix(key, column)
                    keys.append(key.view(np.int64))
            lists = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sketches, pa.binary()), lists], ["unit", "shingles", "sketch", "keys"])

    return map_arrow(sets, run, "unit long, shingles binary, sketch binary, keys array<long>")


def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    left = table.select(F.col("unit").alias("_a"), F.col(column).alias("x"))
    right = table.select(F.col("unit").alias("_b"), F.col(column).alias("y"))
    return pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select("a", "b", "x", "y")


def kept(pairs: DataFrame, test: Callable[[list, list], list[bool]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array(test(b.column(2).to_pylist(), b.column(3).to_pylist()) if b.num_rows else [], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return map_arrow(pairs, run, "a long, b long")


def within(most: int) -> Callable[[list, list], list[bool]]:
    """Whether bit strings of one length differ in at most so many bits."""
    def test(xs: list, ys: list) -> list[bool]:
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1) for v in (xs, ys))
        return (np.bitwise_count(x ^ y).sum(1) <= most).tolist()

    return test


def alike(similar: float) -> Callable[[list, list], list[bool]]:
    """Whether sorted sets of hashes have a Jaccard similarity of at least ``similar``."""
    def test(xs: list, ys: list) -> list[bool]:
        out = []
        for x, y in zip(xs, ys):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            near = min(len(x), len(y)) >= similar * max(len(x), len(y))
            common = len(x) + len(y) - len(np.union1d(x, y)) if near else -1
            out.append(common >= similar * (len(x) + len(y) - common))
        return out

    return test


def _most(similar: float) -> int:
    """The differing sketch bits that a pair at the similarity exceeds with a probability of 1 in 700 (three standard deviations)."""
    bits = FINE_BANDS * FINE_ROWS
    differ = (1 - similar) / 2
    return int(bits * differ + 3 * np.sqrt(bits * differ * (1 - differ)))


def least_shared(keys: Callable[[np.ndarray], np.ndarray], bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key that the rows a and b of ``bits`` share, pair by pair; each pair must share one."""
    own, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    all_keys = keys(bits[own])
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), BLOCK):
        x, y = all_keys[at[:len(a)][i:i + BLOCK]], all_keys[at[len(a):][i:i + BLOCK]]
        out[i:i + BLOCK] = np.where(x == y, x, np.iinfo(np.int64).max).min(1)
    return out


def across(rest: DataFrame, table: DataFrame, most: int, keys: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(a, b): units of different classes in a bucket (key, unit, class, n: units of the bucket) whose sketches are near.

    A task compares a bucket's sketches among themselves and gives back near pairs only; a bucket of over BLOCK units is cut into
    blocks, and each two blocks are a portion of their own, so portions are bounded and no pair is left out. keys: all bucket keys
    of each sketch; where given, a pair that shares several buckets is given back by the one with the smallest key alone, and there
    only if neither is the bucket's smallest unit (column ``least``): such pairs, and those whose smallest shared key is not
    among ``rest``, must have been compared before."""
    rows = rest.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("portion"), "key", (F.col("side") < F.col("other")).alias("low"), (F.col("side") > F.col("other")).alias("high"), "unit", "class", *(["least"] if keys is not None else []))
    rows = rows.join(table.select(F.col("unit").alias("_u"), "sketch"), F.col("unit") == F.col("_u")).drop("_u")

    def near(portion: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(portion)
        unit, of, key = (t.column(c).to_numpy() for c in ("unit", "class", "key"))
        low, high = (t.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
        bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(unit), -1)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(len(unit) - 1):
            # a block meets another one from both sides, but its own units only in its own portion
            rest_ = np.nonzero((of[i + 1:] != of[i]) & ~(low[i] & low[i + 1:]) & ~(high[i] & high[i + 1:]))[0] + i + 1
            hit = rest_[np.bitwise_count(bits[rest_] ^ bits[i]).sum(1) <= most]
            a.append(np.full(len(hit), i))
            b.append(hit)
        a, b = np.concatenate(a), np.concatenate(b)
        if keys is not None and len(a):
            first = least_shared(keys, bits, a, b)
            least = t.column("least").to_numpy()
            at = (key[a] == first) & (key[b] == first) & (unit[a] != least[a]) & (unit[b] != least[b])
            a, b = a[at], b[at]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(unit[a], unit[b])), pa.array(np.maximum(unit[a], unit[b]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = t.column("portion").to_numpy()
            cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:]):
                if held and keys[x] != now:
                    yield near(held)
                    held = []
                now = keys[x]
                held.append(t.slice(x, y - x))
        if held:
            yield near(held)

    return map_arrow(rows.repartition("portion").sortWithinPartitions("portion"), run, "a long, b long")


def classes(table: DataFrame, similar: float, *, buckets: DataFrame | None = None, linked: DataFrame | None = None, most: int | None = None,
            before: int | None = None, keys: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame | None:
    """(unit, class) for the units that are similar to another one; None if there are none.

    table: staged (unit, shingles, sketch); buckets: staged (key, unit) of units that collide, the table's column ``keys`` if none are
    given; linked: links (a, b) known before, those of each bucket's smallest unit at least; most: differing sketch bits that a pair
    may have; before: the buckets there were before ``linked`` closed some of them; keys: see ``across``. In each round every bucket
    compares one leader with its units of other classes, and verified links join classes; buckets whose units are all of one class
    are done. Once no bucket holds more than FEW units, or after STARS rounds, or, where ``linked`` is given, a round closes less
    than half of them, what leaders left apart is compared class against class. So no link between units of a bucket is lost, while
    a bucket of copies makes no more pairs than it has units in a round."""
    most = _most(similar) if most is None else most
    if buckets is None:
        keyed = table.select("unit", F.explode("keys").alias("key"))
        shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select(F.col("key").alias("_key"))
        buckets = stage(keyed.join(shared, F.col("key") == F.col("_key")).select("key", "unit"), "buckets")
    found, met_leaders = None if linked is None else joined(linked), linked is not None
    for turn in range(0 if linked is None else 1, STARS + 1):
        if found is None:
            now = buckets.withColumn("class", F.col("unit"))
        else:
            of = sized(found).withColumnsRenamed({"unit": "_unit", "class": "_class"})
            now = buckets.join(of, F.col("unit") == F.col("_unit"), "left").select("key", "unit", F.coalesce("_class", "unit").alias("class"))
            now = stage(now, "now")
        leader = F.min(F.struct(F.xxhash64("unit", F.lit(turn)).alias("r"), F.col("unit").alias("leader"), F.col("class").alias("of"))).alias("first")
        apart = now.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n"), F.min("unit").alias("least"), leader).filter("lo <> hi")
        apart = stage(apart.select(F.col("key").alias("_key"), "n", "least", F.col("first.leader").alias("leader"), F.col("first.of").alias("of")), "apart")
        widest, open_ = apart.agg(F.max("n"), F.count("*")).first()
        if widest is None:
            break
        apart, same = sized(apart), F.col("key") == F.col("_key")
        last = turn == STARS or bool(turn) and (widest <= FEW or before is not None and 2 * open_ > before)
        before = open_ if met_leaders else None
        if last:
            near = across(stage(now.join(apart, same).select("key", "unit", "class", "n", "least"), "left"), table, most, keys)
        else:
            stars = now.join(apart, same & (F.col("class") != F.col("of"))).select(F.least("unit", "leader").alias("a"), F.greatest("unit", "leader").alias("b"))
            near = kept(with_both(stage(stars.distinct(), "stars"), table, "sketch"), within(most))
        new = stage(exact(stage(near.distinct(), "near"), table, similar), "links")
        if new.limit(1).count():
            linked = new if linked is None else linked.unionByName(new)
            found = joined(linked)
        if last:
            break
    return found


def exact(pairs: DataFrame, table: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have that similarity."""
    return kept(with_both(pairs, table, "shingles"), alike(similar))


def joined(links: DataFrame) -> DataFrame:
    """(unit, class) of what the links (a, b) join."""
    return components(links, "classes").select(F.col("node").alias("unit"), F.col("component").alias("class"))
