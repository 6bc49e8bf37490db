"""Best-fit-decreasing packing of tokenised documents into sequences of fixed length.

Best fit decreasing places pieces from the longest to the shortest, each into the open sequence with the least room that
still holds it; a segment tree over the remaining capacities finds that room in logarithmic time. Pieces of one length
are interchangeable, so the tree is walked for counts of lengths (at most ``capacity`` of them) and the outcome is the
same as if every piece of the whole corpus were placed one by one. Each piece then finds its place by its length and
its rank among the pieces of that length, without any task holding more than its own pieces.

Null texts count as empty; an empty text is the end token alone. Null ids are kept. Repeated rows are packed each. Columns
beside id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stage

CAPACITY = 2048
#: Fixed value: the pattern by which byte-level BPE of this family cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def coder(path: str) -> Callable[[str], list[int]]:
    """The ids of a text by a byte-level BPE tokenizers file, its vocabulary and merge order in tiktoken's encoder, which is several
    times as fast and gives the same ids. A text is cut at the file's added tokens first. Raises if the file is of another kind."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"]:
        raise ValueError(f"{path} holds no plain byte-level BPE")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} holds added tokens that take in what stands around them")
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError(f"{path}: ids do not follow the order of merges")
    # byte-level tokens write each byte as a character: printable Latin-1 as itself, the others in order from U+0100
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in added}
    encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return encoding.encode(text, allowed_special="all")
        return encoding.encode_ordinary(text)

    return encode


def tokenized(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids binary, part, rank): each document's ids and the end token, cut only if over ``capacity``.

    Of a cut document every piece is full but the first. (part, rank) number the pieces of one length within a task; the
    table is staged, so they hold whatever tasks run again."""
    path = path or tokenizer_path()
    tail = np.array([end], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = coder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array(encode(t.as_py() or ""), "<u4").tobytes() + tail
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, k, a, z - a, ids[4 * a:4 * z], part, int(seen[z - a])))
                    seen[z - a] += 1
                held += len(ids)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    pieces = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stage(map_arrow(pieces, run, "doc_id long, piece int, start long, length long, ids binary, part int, rank long"), "pieces")


class Rooms:
    """A segment tree over remaining capacities: how many open sequences have exactly so much room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        """Sequences first .. first + count - 1 now have this room."""
        self.runs[room].append((first, count))
        self._change(room, count)

    def take(self, room: int) -> tuple[int, int]:
        first, count = self.runs[room].pop()
        self._change(room, -count)
        return first, count

    def _change(self, room: int, by: int) -> None:
        i = self.size + room
        while i:
            self.tree[i] += by
            i //= 2

    def tightest(self, length: int) -> int:
        """The least room of at least ``length``, or -1."""
        i = self.size + length
        if self.tree[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, first offset), sorted by length and rank."""
    rooms, opened, out = Rooms(capacity), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = rooms.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                first, count = opened, -(-left // each)
                opened += count
            else:
                each = room // length
                first, count = rooms.take(room)
            full = min(count, left // each)
            used = full
            if full:
                out.append((length, rank, each, first, capacity - room))
                rooms.add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < count:
                out.append((length, rank, left, first + full, capacity - room))
                rooms.add(room - left * length, first + full, 1)
                rank, left, used = rank + left, 0, full + 1
            if used < count:
                rooms.add(room, first + used, count - used)
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with length, part and rank; further columns go along) with sequence_id and offset in place of part and rank.

    The counts of lengths, ``capacity`` rows at most, go to the driver, which makes the plan; the pieces' ranks over all
    parts come from running sums of the counts by part. What is shuffled are the given rows: leave wide ones out."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = plan(by_length, capacity)
    keys = steps[:, 0] * (1 << 48) + steps[:, 1]
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select(F.col("part").alias("_part"), F.col("length").alias("_length"), "before")
    ranked = pieces.join(before, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).withColumn("_rank", F.col("rank") + F.col("before"))
    given = [c for c in pieces.columns if c not in ("part", "rank")]
    ranked = ranked.select(*given, "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            if not len(length):
                continue
            step = steps[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            nth = rank - step[:, 1]
            sequence, offset = step[:, 3] + nth // step[:, 2], step[:, 4] + nth % step[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in given), pa.array(sequence), pa.array(offset)], [*given, "sequence_id", "offset"])

    return map_arrow(ranked, place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in given) + ", sequence_id long, offset long")


def report(docs: DataFrame) -> DataFrame:
    pieces = tokenized(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, **options) -> DataFrame:
    """(sequence_id, doc_ids array, ids binary): the sequences themselves, at most ``capacity`` ids each."""
    parts = packed(tokenized(docs, **options), options.get("capacity", CAPACITY))
    made = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("of"))
    return made.select("sequence_id", F.col("of.doc_id").alias("doc_ids"), F.expr("unhex(array_join(transform(of, x -> hex(x.ids)), ''))").alias("ids"))
