"""Language-model scores by a weighted backoff automaton over n-grams counted from the whole training part.

States are the known histories of up to ``order - 1`` words. An arc of a state carries the smoothed log-probability of a
word that followed the history in training; the failure arc leads to the history without its first word and carries the
history's backoff weight. Reading a text from left to right the automaton carries its state, follows failure arcs until
the word has an arc, adds up the weights and moves to the longest known history. The weights are those of a Dirichlet
prior: p(w | h) = (c(h w) + mu p(w | shorter h)) / (c(h) + mu), so the failure arc weighs mu / (c(h) + mu); each length of history
has its own mu. The lowest state has c(w) / N less the share that words seen once leave to unknown words, which are one type.

Nothing of the corpus is held by one machine: documents are cut into batches of bounded size, a batch asks for the counts
of its own distinct n-grams, and with the answers makes the part of the automaton that its texts can reach. Requests go
to key ranges, and each range sums the counts of all batches for its keys. An n-gram is one key a batch, so neither
frequent words nor groups of copies make a range larger. A request is the sorted keys' differences and the batch's own counts, an
answer what other batches add to them, mostly nothing. N-grams are told apart by hashes of SPARE bits more than the number of
the corpus's tokens has, 64 at most: whatever the size, one look-up in a million meets another n-gram's count.

Null and empty texts are the end token alone. A null id counts as training. Repeated rows count each. Columns beside id and
text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release, stage

#: Words of an n-gram, and the prior's weight for histories of one word, of two.
ORDER, MU = 3, (1000.0, 20.0)
#: Tokens of a batch, and of the corpus for each range of keys.
BATCH, RANGE = 1_000_000, 700_000
#: Bits of a key beyond those that number the corpus's tokens.
SPARE = 20
#: Tokens that are walked at a time.
_WALK = 20_000
#: Fixed value: stands for the end of a text; no word holds white space.
END = xxhash.xxh64_intdigest(b"\n")


def _pack(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else a
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(data, n * size, asbytes=True) if n else b""
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).tobytes(), kind)


def _batches(docs: DataFrame, doc_id: str, text: str, held_mod: int) -> DataFrame:
    """One row a batch: its documents, and their tokens as places in the batch's own list of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0

        def fresh():
            words: dict = defaultdict()
            words.default_factory = words.__len__
            return words, [], [], [], []

        def row() -> pa.RecordBatch:
            keys = np.fromiter((xxhash.xxh64_intdigest(w) if w != b"\n" else END for w in words), "<u8", len(words))
            all_tokens = np.concatenate(tokens)
            values = [[(part << 32) | nth], [ids], [held], [lens], [len(keys)], [_pack(keys)], [_pack(all_tokens)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()))], ["batch", "ids", "held", "lens", "n_words", "words", "tokens"])

        words, ids, held, lens, tokens = fresh()
        size = 0
        for b in batches:
            for doc, out, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = (t.as_py() or b"").lower().split()
                found.append(b"\n")
                tokens.append(np.fromiter(map(words.__getitem__, found), "<u4", len(found)))
                ids.append(doc)
                held.append(out)
                lens.append(len(found))
                size += len(found)
                if size >= BATCH:
                    yield row()
                    nth, size = nth + 1, 0
                    words, ids, held, lens, tokens = fresh()
        if ids:
            yield row()

    out = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % held_mod == 0, F.lit(False))
    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), out.alias("held"), F.col(text).cast("binary").alias("text")), run, "batch long, ids array<long>, held array<boolean>, lens array<int>, n_words int, words binary, tokens binary")


class Grams:
    """A batch's tokens and, for each length up to ``order``, its distinct n-grams and where they stand."""

    def __init__(self, row: dict, order: int, bits: int) -> None:
        self.lens = np.array(row["lens"], np.int64)
        self.held = np.array(row["held"], bool)
        words = _unpack(row["words"], row["n_words"], "<u8")
        total = int(self.lens.sum())
        self.tokens = _unpack(row["tokens"], total, "<u4").astype(np.int64)
        self.begin = np.cumsum(self.lens) - self.lens
        place = (np.arange(total) - np.repeat(self.begin, self.lens)).astype(np.int32)
        learn = ~np.repeat(self.held, self.lens)
        #: For each length: the n-gram that ends at each token (-1: the text is too short there), a token at which each n-gram ends,
        #: keys of ``bits`` bits, counts in training.
        spot = np.zeros(len(words), np.int64)
        spot[self.tokens] = np.arange(total)
        self.at, self.spots, whole, self.counts = [self.tokens.astype(np.int32)], [spot], words, [np.bincount(self.tokens[learn], minlength=len(words))]
        self.keys = [whole >> np.uint64(64 - bits)]
        for n in range(2, order + 1):
            fits = np.nonzero(place >= n - 1)[0]
            code = self.at[-1][fits - 1].astype(np.int64) * len(words) + self.tokens[fits]
            distinct, where = np.unique(code, return_inverse=True)
            at = np.full(total, -1, np.int32)
            at[fits] = where
            spot = np.zeros(len(distinct), np.int64)
            spot[where] = fits
            whole = _mixed(whole[distinct // len(words)], words[distinct % len(words)], n)
            self.keys.append(whole >> np.uint64(64 - bits))
            self.counts.append(np.bincount(where[learn[fits]], minlength=len(distinct)))
            self.at.append(at)
            self.spots.append(spot)


def _mixed(history: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of a history's key and a word's key (multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = history * np.uint64(0x9E3779B97F4A7C15) + (word ^ np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _in_ranges(keys: np.ndarray, ranges: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by key, and the bounds of each range in it."""
    order = np.argsort(keys)
    top = keys[order] << np.uint64(32 - bits) if bits < 32 else keys[order] >> np.uint64(bits - 32)
    of = (top * np.uint64(ranges)) >> np.uint64(32)
    return order, np.searchsorted(of, np.arange(ranges + 1).astype(np.uint64))


def _requests(batches: DataFrame, order: int, ranges: int, bits: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for row in b.to_pylist():
                grams = Grams(row, order, bits)
                for n, (keys, counts) in enumerate(zip(grams.keys, grams.counts), 1):
                    by_key, bounds = _in_ranges(keys, ranges, bits)
                    keys, counts = keys[by_key], counts[by_key].astype("<u4")
                    out = [(k, row["batch"], n, int(z - a), _pack(np.diff(keys[a:z], prepend=np.uint64(0))), _pack(counts[a:z])) for k, (a, z) in enumerate(zip(bounds, bounds[1:])) if z > a]
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["range", "batch", "n", "size", "keys", "counts"])
                del grams

    return map_arrow(batches, run, "range int, batch long, n int, size int, keys binary, counts binary")


def _summed(group: pa.Table) -> pa.Table:
    """One key range: what all other batches add to a batch's own counts, in the order of its keys.

    The rows with batch -1 hold the range's number of training tokens, of words seen, and of words seen once."""
    out = []
    rows = group.to_pylist()
    for n in sorted({r["n"] for r in rows}):
        mine = [r for r in rows if r["n"] == n]
        keys = np.concatenate([np.cumsum(_unpack(r["keys"], r["size"], "<u8"), dtype=np.uint64) for r in mine])
        counts = np.concatenate([_unpack(r["counts"], r["size"], "<u4") for r in mine])
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        sums = np.add.reduceat(counts[order].astype(np.uint64), starts)
        if n == 1:
            out.append((rows[0]["range"], -1, n, [int(sums.sum()), int((sums > 0).sum()), int((sums == 1).sum())], 0, b""))
        more = np.empty(len(keys), "<u8")
        more[order] = np.repeat(sums, np.diff([*starts, len(keys)]))
        more -= counts
        ends = np.cumsum([r["size"] for r in mine])
        out += [(r["range"], r["batch"], n, None, r["size"], _pack(more[e - r["size"]:e])) for r, e in zip(mine, ends)]
    cols = list(zip(*out))
    del rows, keys, counts, order, sums, more
    release()
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary()))], ["range", "batch", "n", "stats", "size", "more"])


class Automaton:
    """The part of the automaton that a batch's texts reach, as flat arrays.

    State 0 is the empty history; the states of level n are the batch's n-grams that training knows. ``arcs[n - 1]`` holds for each
    n-gram the log10 weight of the arc that its last word takes from the state of the words before, NaN where that state has no
    such arc; every word has an arc from the empty history. ``fails[n - 1]`` holds each state's failure weight."""

    def __init__(self, grams: Grams, totals: list[np.ndarray], stats: tuple[int, int, int], mu: tuple[float, ...]) -> None:
        tokens, _, once = stats
        unknown = (once + 0.5) / (tokens + 1)
        self.grams, self.known = grams, totals[0] > 0
        p = np.where(self.known, totals[0] / max(1, tokens) * (1 - unknown), unknown)
        self.arcs, self.fails = [np.log10(p)], []
        for n in range(1, len(totals)):
            m, spot = mu[n - 1], grams.spots[n]
            shorter, history = p[grams.at[n - 1][spot]], totals[n - 1][grams.at[n - 1][spot - 1]]
            p = (totals[n] + m * shorter) / (history + m)
            self.arcs.append(np.where(totals[n] > 0, np.log10(p), np.nan))
            self.fails.append(np.log10(m / (totals[n - 1] + m)))

    def weights(self) -> np.ndarray:
        """The log10 probability of each token: one walk over the texts from left to right."""
        grams, top = self.grams, len(self.arcs) - 1
        total = len(grams.tokens)
        first = np.zeros(total, bool)
        first[grams.begin] = True
        out = np.empty(total)
        level = 0
        for a in range(0, total, _WALK):
            z = min(total, a + _WALK)
            # what stands at each place: the arc of each level into it, and the failure arc of each level's state before it
            arcs = [np.where(at[a:z] >= 0, arc[at[a:z]], np.nan).tolist() for arc, at in zip(self.arcs, grams.at)]
            before = np.maximum(np.arange(a, z) - 1, 0)
            fails = [fail[at[before]].tolist() for fail, at in zip(self.fails, grams.at)]
            known, begins = self.known[grams.tokens[a:z]].tolist(), first[a:z].tolist()
            walked = []
            for i in range(z - a):
                if begins[i]:
                    level = 0
                weight = 0.0
                while level and arcs[level][i] != arcs[level][i]:  # no arc: fail to the shorter history
                    weight += fails[level - 1][i]
                    level -= 1
                walked.append(weight + arcs[level][i])
                if level or known[i]:
                    level = min(level + 1, top)
            out[a:z] = walked
        return out


def _scored(batches: DataFrame, answers: DataFrame, stats: tuple[int, int, int], order: int, mu: tuple[float, ...], ranges: int, bits: int) -> DataFrame:
    tokens, types, _ = stats

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        replies = right.to_pylist()
        for row in left.to_pylist():
            grams = Grams(row, order, bits)
            totals = []
            for n, (keys, counts) in enumerate(zip(grams.keys, grams.counts), 1):
                by_key, _ = _in_ranges(keys, ranges, bits)
                total = counts.astype(np.float64)
                mine = sorted((r for r in replies if r["n"] == n), key=lambda r: r["range"])
                if mine:
                    total[by_key] += np.concatenate([_unpack(r["more"], r["size"], "<u8") for r in mine])
                totals.append(total)
            grams.keys = grams.counts = None
            weights = Automaton(grams, totals, stats, mu).weights()
            count = totals[0][grams.tokens]
            base = np.log10((count + 0.1) / (tokens + 0.1 * (types + 1)))
            out["doc_id"] += row["ids"]
            out["held_out"] += row["held"]
            out["n_tokens"] += grams.lens.tolist()
            for name, value in (("n_known", (count > 0).astype(np.int64)), ("base_score", base), ("score", weights)):
                out[name] += np.add.reduceat(value, grams.begin).tolist()
        release()
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    scored = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, mu: float | tuple[float, ...] = MU, held_mod: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens) for every row; learnt from the rows that are not held out.

    mu: for histories of one word, two and so on; the last one holds for longer ones."""
    mu = mu if isinstance(mu, tuple) else (mu,)
    mu = (mu + mu[-1:] * order)[:order - 1]
    batches = stage(_batches(docs, doc_id, text, held_mod), "batches")
    tokens = batches.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    ranges, bits = max(4, tokens // RANGE), min(64, int(tokens).bit_length() + SPARE)
    answers = _requests(batches, order, ranges, bits).groupBy("range").applyInArrow(_summed, "range int, batch long, n int, stats array<long>, size int, more binary")
    answers = stage(answers, "answers")
    sums = answers.filter("batch = -1").agg(*[F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(3)]).first()
    return _scored(batches, answers.filter("batch >= 0").drop("stats"), tuple(int(x) for x in sums), order, mu, ranges, bits)


def report(docs: DataFrame) -> DataFrame:
    return scores(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
