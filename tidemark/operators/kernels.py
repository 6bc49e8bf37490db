"""Kernels and maximum mean discrepancy.

Over sliding ensembles a kernel is needed only for sub-paths at most a fixed distance apart: each pair of that band is
computed once by an offset-explode and an equi-join, and block sums are taken from the band. Kernels between whole groups
of vectors are computed block against block in numpy, each task holding two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import chunked, ordered

#: Rows of a block.
BLOCK = 2048


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def rbf(a: str | Column, b: str | Column, *, sigma: float | Column | None = None, gamma: float | Column | None = None) -> Column:
    """exp(-d2 / (2 sigma^2)), or exp(-gamma d2), or with neither the dot product."""
    if gamma is not None:
        return F.exp(-squared_distance(a, b) * gamma)
    if sigma is None:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.exp(-squared_distance(a, b) / (2 * sigma * sigma))


def band(df: DataFrame, vector: str, width: int, *, sigma: float | None = None, gamma: float | None = None, index: str = "i") -> DataFrame:
    """(series_id, i, off, k): the kernel of the vectors at i and i + off for off from 0 to width."""
    left = df.filter(F.col(vector).isNotNull()).select("series_id", F.col(index).alias("i"), F.col(vector).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(width))).alias("off"))
    right = df.filter(F.col(vector).isNotNull()).select("series_id", F.col(index).alias("_j"), F.col(vector).alias("_b"))
    pairs = left.withColumn("_j", F.col("i") + F.col("off")).join(right, ["series_id", "_j"])
    return pairs.select("series_id", "i", "off", rbf("_a", "_b", sigma=sigma, gamma=gamma).alias("k"))


def mmd2(kxx: Column, kyy: Column, kxy: Column, n: Column | int, m: Column | int, mode: str = "raw") -> Column:
    """The unbiased statistic from sums over ordered pairs (diagonals excluded in kxx and kyy); below two members it is 0.

    mode: raw may be negative, clip is at least 0, sqrt is the root of that."""
    n, m = (F.lit(v) if isinstance(v, int) else v for v in (n, m))
    one = lambda v: F.when(v > 1, v)
    raw = F.coalesce(kxx / (one(n) * (n - 1)) + kyy / (one(m) * (m - 1)) - 2 * kxy / (one(n) * one(m)), F.lit(0.0))
    return {"raw": raw, "clip": F.greatest(raw, F.lit(0.0)), "sqrt": F.sqrt(F.greatest(raw, F.lit(0.0)))}[mode]


def lag_scores(df: DataFrame, vector: str, size: int, lags: dict[int, float], *, sigma: float | None = None, gamma: float | None = None, mode: str = "raw", normalize: bool = True) -> DataFrame:
    """(series_id, i, score): weighted discrepancy of the ensemble of ``size`` sub-paths from i on, and those ``lag`` before.

    Null until the longest lag. The band's kernels are summed by ensemble: within it over offsets below size, across
    over offsets lag - size + 1 to lag + size - 1, each as a count of (ensemble, pair) memberships."""
    longest = max(lags)
    pairs = band(df, vector, longest + size - 1, sigma=sigma, gamma=gamma)
    # ordered by their first member: pair (a, a + off) lies in ensembles a + off - size + 1 .. a
    inner = pairs.filter((F.col("off") > 0) & (F.col("off") < size)).withColumn("e", F.explode(F.sequence(F.col("i") + F.col("off") - size + 1, F.col("i"))))
    within = inner.groupBy("series_id", "e").agg((2 * F.sum("k")).alias("within"))
    lag_table = F.explode(F.array(*[F.lit(l) for l in lags]))
    # a in the earlier ensemble e - lag, b = a + off in the later one e; signs are handled by taking both orders
    both = pairs.unionByName(pairs.filter("off > 0").select("series_id", (F.col("i") + F.col("off")).alias("i"), (-F.col("off")).alias("off"), "k"))
    across = both.withColumn("lag", lag_table).filter((F.col("off") > F.col("lag") - size) & (F.col("off") < F.col("lag") + size))
    lo = F.greatest(F.col("i") + F.col("lag") - size + 1, F.col("i") + F.col("off") - size + 1)
    hi = F.least(F.col("i") + F.col("lag"), F.col("i") + F.col("off"))
    across = across.withColumn("e", F.explode(F.sequence(lo, hi))).groupBy("series_id", "e", "lag").agg(F.sum("k").alias("across"), F.count("*").alias("n"))
    across = across.filter(F.col("n") == size * size)
    before = within.select("series_id", F.col("e").alias("_e"), F.col("within").alias("before"))
    joined = across.join(within, ["series_id", "e"]).withColumn("_e", F.col("e") - F.col("lag")).join(before, ["series_id", "_e"])
    value = mmd2(F.col("within"), F.col("before"), F.col("across"), size, size, mode)
    weight = F.element_at(F.create_map(*[F.lit(v) for pair in lags.items() for v in pair]), F.col("lag"))
    total = sum(lags.values()) if normalize else 1.0
    scored = joined.groupBy("series_id", "e").agg((F.sum(value * weight) / total).alias("score"), F.count("*").alias("n")).filter(F.col("n") == len(lags))
    return scored.select("series_id", F.col("e").alias("i"), "score")


def consecutive_scores(df: DataFrame, vector: str, group: str, *, sigma: float | None = None, gamma: float | None = None, mode: str = "clip") -> DataFrame:
    """(series_id, group, score): each group of vectors against the one before it (groups numbered from 0, without gaps)."""
    v = df.filter(F.col(vector).isNotNull()).select("series_id", F.col(group).alias("g"), F.col("i"), F.col(vector).alias("v"))
    a = v.select("series_id", "g", F.col("i").alias("_i"), F.col("v").alias("_a"), F.explode(F.array(F.lit(0), F.lit(1))).alias("d")).withColumn("_g", F.col("g") + F.col("d"))
    b = v.select("series_id", F.col("g").alias("_g"), F.col("i").alias("_j"), F.col("v").alias("_b"))
    pairs = a.join(b, ["series_id", "_g"]).filter((F.col("d") == 1) | (F.col("_i") != F.col("_j")))
    sums = pairs.groupBy("series_id", "g", "d").agg(F.sum(rbf("_a", "_b", sigma=sigma, gamma=gamma)).alias("s"), F.countDistinct("_i").alias("n"))
    own = sums.filter("d = 0").select("series_id", "g", F.col("s").alias("own"), "n")
    after = own.select("series_id", (F.col("g") - 1).alias("g"), F.col("own").alias("next"), F.col("n").alias("m"))
    cross = sums.filter("d = 1").select("series_id", "g", F.col("s").alias("cross"))
    joined = cross.join(own, ["series_id", "g"]).join(after, ["series_id", "g"])
    return joined.select("series_id", (F.col("g") + 1).alias(group), mmd2(F.col("own"), F.col("next"), F.col("cross"), F.col("n"), F.col("m"), mode).alias("score"))


def reference_scores(df: DataFrame, columns: list[str], reference: int, test: int, *, mode: str = "raw") -> DataFrame:
    """Linear-kernel discrepancy of the ``test`` rows up to the present one and the ``reference`` rows before those.

    With a linear kernel the pair sums are squares of sums less sums of squares, so frames suffice."""
    late = ordered().rowsBetween(-(test - 1), 0)
    early = ordered().rowsBetween(-(test + reference - 1), -test)
    xx = yy = xy = F.lit(0.0)
    for c in columns:
        sx, sy = F.sum(c).over(early), F.sum(c).over(late)
        xx = xx + sx * sx - F.sum(F.col(c) * F.col(c)).over(early)
        yy = yy + sy * sy - F.sum(F.col(c) * F.col(c)).over(late)
        xy = xy + sx * sy
    full = F.col("i") >= reference + test
    return df.withColumn("score", F.when(full, mmd2(xx, yy, xy, reference, test, mode)))


def _blocked(df: DataFrame, vector: str, blocks: int, extra: list[str]) -> DataFrame:
    """Each row in every pair of blocks that its own block is part of: (p, q, side, vector, extra)."""
    b = F.pmod(F.xxhash64(vector), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    out = df.withColumn("_b", b).withColumn("_o", other)
    return out.select(F.least("_b", "_o").alias("p"), F.greatest("_b", "_o").alias("q"), F.col("_b").alias("side"), F.col(vector).cast("array<double>").alias("v"), *extra)


def group_kernel_sums(df: DataFrame, vector: str, label: str, *, sigma: float = 1.0, blocks: int = 4) -> DataFrame:
    """(a, b, s, n): for labels a <= b the sum of the RBF kernel over pairs of distinct rows, each unordered pair once."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1)
        side, labels = table.column("side").to_numpy(), table.column("label").to_numpy()
        p, q = key[0].as_py(), key[1].as_py()
        left, right = np.nonzero(side == p)[0], np.nonzero(side == q)[0]
        sums: dict[tuple[int, int], list] = {}
        for i in range(0, len(left), BLOCK):
            rows = left[i:i + BLOCK]
            for j in range(0, len(right), BLOCK):
                cols = right[j:j + BLOCK]
                d = (x[rows] ** 2).sum(1)[:, None] + (x[cols] ** 2).sum(1)[None] - 2 * x[rows] @ x[cols].T
                k = np.exp(-np.maximum(d, 0) / (2 * sigma * sigma))
                keep = rows[:, None] < cols[None] if p == q else np.ones_like(k, bool)
                for a in np.unique(labels[rows]):
                    for b in np.unique(labels[cols]):
                        part = keep & (labels[rows] == a)[:, None] & (labels[cols] == b)[None]
                        s = sums.setdefault((int(min(a, b)), int(max(a, b))), [0.0, 0])
                        s[0] += float(k[part].sum())
                        s[1] += int(part.sum())
        rows = [(a, b, s, n) for (a, b), (s, n) in sums.items()]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64()))], ["a", "b", "s", "n"])

    dealt = _blocked(df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()), vector, blocks, [F.col(label).cast("int").alias("label")])
    found = dealt.groupBy("p", "q").applyInArrow(run, "a int, b int, s double, n long")
    return found.groupBy("a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def group_mmd2(df: DataFrame, vector: str, label: str, *, sigma: float = 1.0, mode: str = "raw", blocks: int = 4) -> DataFrame:
    """(a, b, mmd2) for every pair of labels a < b."""
    sums = group_kernel_sums(df, vector, label, sigma=sigma, blocks=blocks)
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(vector).alias("members"))
    own = sums.filter("a = b").select(F.col("a").alias("label"), (2 * F.col("s")).alias("own")).join(counts, "label")
    x = own.select(F.col("label").alias("a"), F.col("own").alias("kxx"), F.col("members").alias("n_a"))
    y = own.select(F.col("label").alias("b"), F.col("own").alias("kyy"), F.col("members").alias("n_b"))
    return sums.filter("a < b").join(x, "a").join(y, "b").select("a", "b", mmd2(F.col("kxx"), F.col("kyy"), F.col("s"), F.col("n_a"), F.col("n_b"), mode).alias("mmd2"))


def median_bandwidth(df: DataFrame, vector: str, key: str, group: str) -> DataFrame:
    """(group, sigma, gamma): root of half the median squared distance over pairs i < j of a group, and 1 over the median (1 if 0).

    For windows of bounded size: the pairs of a group are joined on it."""
    a = df.select(F.col(group).alias("g"), F.col(key).alias("_i"), F.col(vector).alias("_a"))
    b = df.select(F.col(group).alias("g"), F.col(key).alias("_j"), F.col(vector).alias("_b"))
    d = a.join(b, "g").filter(F.col("_i") < F.col("_j")).groupBy("g").agg(F.percentile(squared_distance("_a", "_b"), 0.5).alias("med"))
    return d.select(F.col("g").alias(group), F.sqrt(F.col("med") / 2).alias("sigma"), F.when(F.col("med") > 0, 1 / F.when(F.col("med") > 0, F.col("med"))).otherwise(1.0).alias("gamma"))


def window_scores(df: DataFrame, columns: list[str], reference: int, test: int, *, length: int = 5000) -> DataFrame:
    """score: root of the RBF discrepancy of the last ``test`` rows from the ``reference`` rows before them, with each row's own median
    bandwidth. Windows are bounded, so long series run as many chunks with that much history."""
    span = reference + test
    base = df.select("series_id", "i", F.array(*[F.col(c).cast("double") for c in columns]).alias("v")).filter(~F.exists("v", lambda x: x.isNull()))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("i").to_numpy())
        i, own = table.column("i").to_numpy()[order], table.column("own").to_numpy(zero_copy_only=False)[order]
        x = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1)[order]
        out_i, out_s = [], []
        for z in range(span, len(i) + 1):
            if not own[z - 1] or i[z - 1] - i[z - span] != span - 1:
                continue
            w = x[z - span:z]
            sq = (w * w).sum(1)
            d = np.maximum(sq[:, None] + sq[None] - 2 * w @ w.T, 0)
            med = float(np.median(d[np.triu_indices(span, 1)]))
            k = np.exp(-d / med) if med > 0 else np.ones_like(d)
            a, b, c = k[:reference, :reference], k[reference:, reference:], k[:reference, reference:]
            stat = (a.sum() - reference) / (reference * (reference - 1)) + (b.sum() - test) / (test * (test - 1)) - 2 * c.mean()
            out_i.append(int(i[z - 1]))
            out_s.append(float(np.sqrt(max(0.0, stat))))
        sid = table.column("series_id")[0].as_py() if table.num_rows else None
        return pa.table({"series_id": pa.array([sid] * len(out_i), pa.string()), "i": pa.array(out_i, pa.int32()), "score": pa.array(out_s, pa.float64())})

    found = chunked(base, length, span - 1).groupBy("series_id", "chunk").applyInArrow(run, "series_id string, i int, score double")
    return df.join(found, ["series_id", "i"], "left")
