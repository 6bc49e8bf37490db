"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

Vectors are dealt to shards of a bounded size by a hash of their id. A shard's graph has layers, each node's highest one
drawn at random with geometrically falling odds. Nodes are inserted by searching the graph made so far, up to TOGETHER of them in
step: a node is linked to a choice of what it finds in each of its layers, each nearer to it than to the ones already chosen, and
they are linked back, with the same choice where a row is full. The neighbours of a layer are one flat array, padded with -1. A
search goes down greedily and widens to ``ef`` candidates in the lowest layer. Equal vectors of a shard are one node with several
ids, so copies don't crowd a graph.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; vectors of
another dimension than a query's are no candidates of it. Of query rows that repeat an id the smallest vector asks.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Vectors of a shard and queries of a block, on average; links of a node; candidates of its links; breadth of a search.
SHARD, BLOCK = 4096, 4096
LINKS, CONSTRUCTION, EF = 16, 64, 128
#: Nodes that are inserted, and queries that search, in step.
TOGETHER = 256


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


class Graph:
    """A shard's index: distinct vectors, the ids of each, and per layer its nodes and their neighbours as flat arrays."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, links: int = LINKS, construction: int = CONSTRUCTION) -> None:
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], vectors[by_id]
        self.vectors, node = np.unique(vectors, axis=0, return_inverse=True)
        node = node.reshape(-1)
        self.of = ids[np.argsort(node, kind="stable")]
        self.bounds = np.searchsorted(np.sort(node), np.arange(len(self.vectors) + 1))
        n = len(self.vectors)
        rng = np.random.default_rng(n)
        self.levels = np.minimum((-np.log(rng.random(n)) / np.log(links)).astype(np.int8), 6)
        order = rng.permutation(n)
        order = order[np.argsort(self.levels[order] < self.levels.max(), kind="stable")]
        #: The first node inserted is in every layer, so all searches enter there.
        self.entry = int(order[0])
        self.tables = [np.full((n, links if layer else 2 * links), -1, np.int32) for layer in range(int(self.levels.max()) + 1)]
        a, z = 0, 1
        while a < n:
            self._insert(order[a:z], links, construction, a > 0)
            a, z = z, z + min(TOGETHER, z)

    def _insert(self, nodes: np.ndarray, links: int, construction: int, searchable: bool) -> None:
        """Insert nodes together: each searches the graph made so far from the top layer down, and sees those of the others that
        stand before it; of what it finds in each of its layers it is linked to a diverse choice."""
        x = self.vectors
        at = np.full(len(nodes), self.entry)
        for layer in range(len(self.tables) - 1, -1, -1):
            deep = self.levels[nodes] >= layer
            mine = nodes[deep]
            near, dist = np.empty((len(mine), 0), np.int64), np.empty((len(mine), 0))
            if searchable:
                if not deep.all():
                    at[~deep] = self._beam(layer, x[nodes[~deep]], at[~deep], 1)[0][:, 0]
                if deep.any():
                    near, dist = self._beam(layer, x[mine], at[deep], construction)
                    at[deep] = near[:, 0]
            if not len(mine):
                continue
            mates = ((x[mine][:, None, :] - x[mine][None]) ** 2).sum(2)
            mates[np.triu_indices(len(mine))] = np.inf
            near, dist = np.concatenate([near, np.broadcast_to(mine, mates.shape)], 1), np.concatenate([dist, mates], 1)
            by = np.argsort(dist, axis=1, kind="stable")[:, :construction]
            near, dist = np.take_along_axis(near, by, 1), np.take_along_axis(dist, by, 1)
            chosen = _diverse(x, near, dist, links)
            self.tables[layer][mine, :links] = chosen
            self._link_back(layer, mine, chosen)

    def _link_back(self, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Link the chosen to those that chose them; a row that overflows keeps a diverse choice."""
        table, x = self.tables[layer], self.vectors
        source, slot = np.nonzero(chosen >= 0)
        target = chosen[source, slot]
        by = np.argsort(target, kind="stable")
        source, target = nodes[source[by]], target[by]
        distinct, first, count = np.unique(target, return_index=True, return_counts=True)
        for a in range(0, len(distinct), 512):
            rows, n = distinct[a:a + 512], count[a:a + 512]
            new = np.full((len(rows), int(n.max())), -1, np.int64)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            new[np.repeat(np.arange(len(rows)), n), place] = source[first[a]:first[a] + n.sum()]
            near = np.concatenate([table[rows].astype(np.int64), new], 1)
            dist = np.where(near >= 0, ((x[near] - x[rows][:, None, :]) ** 2).sum(2), np.inf)
            by = np.argsort(dist, axis=1, kind="stable")
            near, dist = np.take_along_axis(near, by, 1), np.take_along_axis(dist, by, 1)
            kept = near[:, :table.shape[1]]
            full = np.isfinite(dist).sum(1) > table.shape[1]
            if full.any():
                kept[full] = _diverse(x, near[full], dist[full], table.shape[1])
            table[rows] = kept

    def _beam(self, layer: int, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query (a row) up to ``ef`` nodes near it and their squared distances, nearest first; -1 and infinite where fewer
        are reached. All queries go on in step: each expands the nearest node that it has not expanded, until all that it holds are."""
        x, table = self.vectors, self.tables[layer]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(x)), bool)
        seen[rows, entry] = True
        near, dist = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), np.inf)
        near[:, 0], dist[:, 0] = entry, ((x[entry] - q) ** 2).sum(1)
        done = np.zeros((len(q), ef), bool)
        while len(rows):
            left = np.where(done[rows], np.inf, dist[rows])
            best = left.argmin(1)
            go = np.isfinite(left[np.arange(len(rows)), best])
            rows, best = rows[go], best[go]
            if not len(rows):
                break
            done[rows, best] = True
            found = table[near[rows, best]].astype(np.int64)
            fresh = (found >= 0) & ~seen[rows[:, None], found]
            seen[rows[:, None], np.where(fresh, found, entry[rows][:, None])] = True
            gaps = x[found] - q[rows][:, None, :]
            gaps = np.where(fresh, np.einsum("ijk,ijk->ij", gaps, gaps), np.inf)
            all_near, all_dist = np.concatenate([near[rows], found], 1), np.concatenate([dist[rows], gaps], 1)
            all_done = np.concatenate([done[rows], np.zeros_like(fresh)], 1)
            by = np.argpartition(all_dist, ef - 1, axis=1)[:, :ef]
            near[rows], dist[rows], done[rows] = (np.take_along_axis(v, by, 1) for v in (all_near, all_dist, all_done))
        by = np.argsort(dist, axis=1, kind="stable")
        near, dist = np.take_along_axis(near, by, 1), np.take_along_axis(dist, by, 1)
        return np.where(np.isfinite(dist), near, -1), dist

    def nearest(self, q: np.ndarray, query_ids: np.ndarray, k: int, ef: int) -> list[list[tuple[int, float]]]:
        """For each query the k nearest ids found but its own, ties to smaller ids, with their distances."""
        out = []
        for a in range(0, len(q), TOGETHER):
            some = q[a:a + TOGETHER]
            at = np.full(len(some), self.entry)
            for layer in range(len(self.tables) - 1, 0, -1):
                at = self._beam(layer, some, at, 1)[0][:, 0]
            near, _ = self._beam(0, some, at, max(ef, k + 1))
            for v, own, nodes in zip(some, query_ids[a:a + TOGETHER].tolist(), near[:, :k + 1]):
                rows = []
                for node in nodes[nodes >= 0].tolist():
                    ids = self.of[self.bounds[node]:self.bounds[node + 1]]
                    dist = float(np.sqrt(((self.vectors[node] - v) ** 2).sum()))
                    rows += [(dist, int(i)) for i in ids[:k + 1 + int((ids == own).sum())] if i != own]
                out.append([(i, d) for d, i in sorted(rows)[:k]])
        return out


def _diverse(x: np.ndarray, near: np.ndarray, dist: np.ndarray, links: int) -> np.ndarray:
    """For each row of candidates (nearest first) up to ``links`` of those nearer to the row's node than to any one chosen before;
    then the nearest others. -1 where there are fewer."""
    n, k = near.shape
    chosen = np.full((n, links), -1, np.int64)
    count, taken = np.zeros(n, np.int64), np.zeros((n, k), bool)
    for r in range(k):
        go = np.nonzero((count < links) & np.isfinite(dist[:, r]))[0]
        if not len(go):
            continue
        other = chosen[go]
        gaps = ((x[near[go, r]][:, None, :] - x[other]) ** 2).sum(2)
        gaps[other < 0] = np.inf
        good = go[gaps.min(1) > dist[go, r]]
        chosen[good, count[good]] = near[good, r]
        taken[good, r] = True
        count[good] += 1
    for r in range(k):
        go = np.nonzero((count < links) & np.isfinite(dist[:, r]) & ~taken[:, r])[0]
        chosen[go, count[go]] = near[go, r]
        count[go] += 1
    return chosen


def index(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD, links: int = LINKS) -> tuple[DataFrame, int]:
    """The staged index (dim, shard, graph binary) of every valid vector, and its number of shards."""
    v = valid(vectors, vec_id, embedding)
    shards = max(1, -(-v.count() // shard))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        graph = Graph(group.column("vec_id").to_numpy().astype(np.int64), _matrix(group.column("v"), dim), links)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "graph": pa.array([pickle.dumps(graph, 5)], pa.binary())})

    dealt = v.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    return stage(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, graph binary"), "graphs"), shards


def search(graphs: DataFrame, shards: int, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, ef: int = EF, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query against every shard, in blocks of queries, the shards' best merged by distance and id."""
    q = valid(queries, vec_id, embedding).groupBy("vec_id").agg(F.min("v").alias("v"))
    q = stage(q, "queries")
    blocks = max(1, -(-q.count() // block))
    asked = q.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    sides = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            graph = pickle.loads(left.column("graph")[0].as_py())
            asking = right.column("vec_id").to_numpy()
            for query, found in zip(asking.tolist(), graph.nearest(_matrix(right.column("v"), key[0].as_py()), asking, k, ef)):
                for i, d in found:
                    out[0].append(query)
                    out[1].append(i)
                    out[2].append(d)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["dim", "shard", "block"]
    found = sides.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    graphs, shards = index(vectors)
    return search(graphs, shards, vectors.filter(F.col("vec_id") % 100 == 0))
