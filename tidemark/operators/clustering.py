"""Clustering of a series' feature rows: k-means over any number of them, linkage on bounded samples, quantile bins without a fit.

Every series is clustered by its own rows alone, so its regimes do not depend on which other series are in the table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..series import ordered, rows, settled, whole
from .paths import standardized

#: Rows of a series beyond which linkage takes every second, third ... one, as the reference does.
SAMPLE = 3000
#: Rows of a series that a k-means fit may hold in one task; iterations of a fit.
LONG, ROUNDS = 1_000_000, 500


def tercile_regimes(df: DataFrame, *, ret: str = "ret", n: int = 20, bins: int = 3) -> DataFrame:
    """Regimes by quantile bins of the annualised n-row volatility, without any fit beyond the breakpoints (looks ahead for them).

    Rows before the first full window take the first known volatility's bin. Confidence is the distance to the nearer breakpoint relative to the
    volatility's range, from 0.5 to 1."""
    vol = F.when(F.count(ret).over(rows(n)) == n, F.stddev_samp(ret).over(rows(n)) * F.sqrt(F.lit(252.0)))
    df = df.withColumn("vol", vol)
    fill = F.coalesce("vol", F.first("vol", ignorenulls=True).over(ordered().rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("vol", fill).withColumn("_cuts", F.percentile("vol", F.array(*[F.lit(k / bins) for k in range(1, bins)])).over(whole()))
    over = [(F.col("vol") > F.get("_cuts", F.lit(k))).cast("int") for k in range(bins - 1)]
    gaps = [F.abs(F.col("vol") - F.get("_cuts", F.lit(k))) for k in range(bins - 1)]
    spread = F.max("vol").over(whole()) - F.min("vol").over(whole())
    gap = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    df = df.withColumn("regime", sum(over[1:], over[0]))
    return df.withColumn("confidence", F.when(spread > 0, F.least(F.lit(1.0), 0.5 + gap / F.when(spread > 0, spread))).otherwise(0.5)).drop("_cuts")


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(centres, sum of squared distances) of one k-means fit: spread-out starting rows, then means until no row changes sides."""
    start = [int(rng.integers(len(x)))]
    gap = ((x - x[start[0]]) ** 2).sum(1)
    while len(start) < k and gap.max() > 0:
        start.append(int(rng.choice(len(x), p=gap / gap.sum())))
        gap = np.minimum(gap, ((x - x[start[-1]]) ** 2).sum(1))
    centres, side = x[start].copy(), None
    for _ in range(rounds):
        d = np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
        now = d.argmin(1)
        if side is not None and (now == side).all():
            break
        side = now
        sums, n = np.zeros_like(centres), np.bincount(side, minlength=len(centres))
        np.add.at(sums, side, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres, float(np.stack([((x - c) ** 2).sum(1) for c in centres], 1).min(1).sum())


def kmeans(df: DataFrame, columns: list[str], k: int = 3, *, scale: bool = True, seed: int = 42, tries: int = 10, out: str = "regime") -> DataFrame:
    """For each series the best of ``tries`` k-means fits over its rows with every column known; clusters numbered by the first
    column's mean, and ``d_own`` and ``d_other``: distances to the own and the nearest other centre. Rows with a null column
    get none; a series with fewer than k different rows has as many clusters as those.

    A series' fit is one task that holds its columns; series of over LONG rows are fitted one after the other by MLlib over all tasks.
    Rows are assigned where they are, by a join with the few centres."""
    names = [f"_f_{c}" for c in columns]
    known = df.dropna(subset=columns).withColumns({n: F.col(c).cast("double") for n, c in zip(names, columns)})
    scaled = settled(standardized(known, names) if scale else known)
    features = scaled.select("series_id", F.array(*names).alias("v"))
    sizes = settled(features.groupBy("series_id").agg(F.count("*").alias("n")))
    long = [r[0] for r in sizes.filter(F.col("n") > LONG).select("series_id").toLocalIterator()]

    def run(table: pa.Table) -> pa.Table:
        x = np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
        x = x[np.lexsort(x.T[::-1])]  # the same whatever order the rows come in
        best = min((lloyd(x, k, np.random.default_rng(seed + t)) for t in range(tries)), key=lambda fit: fit[1])[0]
        return pa.table({"series_id": table.column("series_id")[:1], "_centres": pa.array([sorted(best.tolist())], pa.list_(pa.list_(pa.float64())))})

    schema = f"series_id {df.schema['series_id'].dataType.simpleString()}, _centres array<array<double>>"
    short = features if not long else features.join(F.broadcast(sizes.filter(F.col("n") <= LONG).select("series_id")), "series_id", "left_semi")
    centres = short.groupBy("series_id").applyInArrow(run, schema)
    for one in long:
        vectors = VectorAssembler(inputCols=names, outputCol="_v").transform(scaled.filter(F.col("series_id") == one))
        fits = [KMeans(k=k, seed=seed + t, featuresCol="_v", maxIter=ROUNDS).fit(vectors) for t in range(tries)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        centres = centres.unionByName(df.sparkSession.createDataFrame([(one, sorted(list(map(float, c)) for c in best.clusterCenters()))], schema))
    return assigned(scaled, names, settled(centres), out).drop(*names)


def assigned(df: DataFrame, columns: list[str], centres: DataFrame, out: str = "regime") -> DataFrame:
    """Each row's nearest centre of its series and the two distances; centres: (series_id, _centres), numbered in their order."""
    own = centres.select(F.col("series_id").alias("_s"), "_centres")
    square = lambda c: sum(((F.col(n) - c[j]) * (F.col(n) - c[j]) for j, n in enumerate(columns)), F.lit(0.0))
    df = df.join(own, F.col("series_id") == F.col("_s")).withColumn("_d", F.transform("_centres", lambda c: F.sqrt(square(c))))
    df = df.withColumn(out, (F.array_position("_d", F.array_min("_d")) - 1).cast("int"))
    other = F.array_min(F.filter("_d", lambda x, i: i != F.col(out)))
    return df.withColumn("d_own", F.array_min("_d")).withColumn("d_other", other).drop("_d", "_s", "_centres")


def cluster_regimes(df: DataFrame, columns: list[str], k: int = 3, *, regime: str = "regime", at_least: int = 3, seed: int = 42) -> DataFrame:
    """Cluster the regimes' mean feature rows (of regimes with ``at_least`` rows) and give every row its regime's cluster; rows of
    smaller regimes get 0. With k regimes or fewer each is its own cluster."""
    means = df.groupBy("series_id", F.col(regime).alias("_regime")).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in columns]).filter(F.col("_n") >= at_least)
    few = F.count("*").over(whole()) <= k
    means = settled(means.withColumn("_few", few).withColumn("_rank", F.row_number().over(Window.partitionBy("series_id").orderBy("_regime")) - 1))
    fitted = kmeans(means.filter("not _few"), [f"_m_{c}" for c in columns], k, seed=seed, out="_cluster").select("series_id", "_regime", "_cluster")
    fitted = fitted.unionByName(means.filter("_few").select("series_id", "_regime", F.col("_rank").cast("int").alias("_cluster"))).withColumnRenamed("series_id", "_s")
    joined = df.join(fitted, (F.col("series_id") == F.col("_s")) & (F.col(regime) == F.col("_regime")), "left")
    return joined.withColumn("cluster", F.coalesce("_cluster", F.lit(0)).cast("int")).drop("_s", "_regime", "_cluster")


def cluster_count(changes: int, *, most: int = 4, extra: int = 1) -> int:
    return min(most, max(2, min(8, changes + extra)))


def clean_distances(d: np.ndarray) -> np.ndarray:
    """Non-finite entries as ten times the largest, none negative, symmetric, a zero diagonal."""
    finite = d[np.isfinite(d)]
    d = np.where(np.isfinite(d), d, 10 * (finite.max() if len(finite) else 1.0))
    d = np.maximum((d + d.T) / 2, 0)
    np.fill_diagonal(d, 0)
    return d


def linkage_labels(d: np.ndarray, k: int, method: str = "ward") -> np.ndarray:
    """Agglomerative clusters of a distance matrix cut at k, by nearest-neighbour chains (ward or average)."""
    n = len(d)
    if n <= k:
        return np.arange(n)
    work = clean_distances(d.astype(float)) ** (2 if method == "ward" else 1)
    np.fill_diagonal(work, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.nonzero(alive)[0][0])]
        a = chain[-1]
        row = np.where(alive, work[a], np.inf)
        b = chain[-2] if len(chain) > 1 and row[chain[-2]] == row.min() else int(row.argmin())
        if len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            merges.append((work[a, b], a, b))
            if method == "ward":
                new = ((size[a] + size) * work[a] + (size[b] + size) * work[b] - size * work[a, b]) / (size[a] + size[b] + size)
            else:
                new = (size[a] * work[a] + size[b] * work[b]) / (size[a] + size[b])
            alive[b] = False
            size[a] += size[b]
            new[~alive] = np.inf
            new[a] = np.inf
            work[a], work[:, a] = new, new
        else:
            chain.append(b)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, a, b in sorted(merges, key=lambda m: m[0])[:n - k]:
        parent[find(a)] = find(b)
    roots = [find(x) for x in range(n)]
    order = {r: j for j, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots])


def ward_regimes(df: DataFrame, vector: str, k: int, *, sigma: float = 1.0, sample: int = SAMPLE, method: str = "ward", out: str = "regime") -> DataFrame:
    """Linkage on RKHS distances root(2 - 2k) of every ``step``-th vector of a series (``sample`` of them at most); other rows take the first
    sampled label at or after them. Each series is one task holding its sample; the rest stays distributed."""
    known = df.filter(F.col(vector).isNotNull())
    step = F.greatest(F.lit(1), F.ceil(F.count("*").over(whole()) / sample))
    chosen = known.withColumn("_nth", F.row_number().over(ordered())).withColumn("_step", step).filter((F.col("_nth") - 1) % F.col("_step") == 0)

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("i").to_numpy())
        x = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1)[order]
        square = (x * x).sum(1)
        kernel = np.exp(-np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0) / (2 * sigma * sigma))
        labels = linkage_labels(np.sqrt(np.maximum(2 - 2 * kernel, 0)), k, method)
        return pa.table({"series_id": table.column("series_id"), "i": pa.array(table.column("i").to_numpy()[order], pa.int32()), "_label": pa.array(labels, pa.int32())})

    labels = chosen.select("series_id", F.col("i").cast("int").alias("i"), F.col(vector).cast("array<double>").alias("v")).groupBy("series_id").applyInArrow(run, "series_id string, i int, _label int")
    joined = df.join(labels, ["series_id", "i"], "left")
    after = F.first("_label", ignorenulls=True).over(ordered().rowsBetween(0, Window.unboundedFollowing))
    before = F.last("_label", ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(out, F.coalesce(after, before)).drop("_label")
