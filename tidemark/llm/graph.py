"""Connected components of an edge table, by local contraction and alternating star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage

#: Edges that one local union-find holds at a time.
CHUNK = 200_000


def _forest(src: list, dst: list) -> pa.RecordBatch:
    """(node, root) for each node that is not its tree's smallest node."""
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, root)
        return root

    for a, b in zip(src, dst):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["src", "dst"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    src, dst = [], []
    for b in batches:
        src += b.column(0).to_pylist()
        dst += b.column(1).to_pylist()
        if len(src) > CHUNK:
            yield _forest(src, dst)
            src, dst = [], []
    if src:
        yield _forest(src, dst)


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with at most one edge for each node and chunk, each from a larger to a smaller node."""
    return map_arrow(edges, _contract, "src long, dst long")


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Link every neighbour of a node to the node's smallest neighbour: the larger ones (both) or the smaller ones.

    The smallest neighbour is a partial aggregate, so a node with very many neighbours costs one row for each task."""
    pairs = edges if not both else edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = pairs.groupBy("src").agg(F.min("dst").alias("least")).select(F.col("src").alias("_n"), F.least("least", "src").alias("least"))
    joined = pairs.join(least, F.col("src") == F.col("_n"))
    kept = joined.filter(F.col("dst") > F.col("src")) if both else joined
    out = kept.select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    if not both:
        out = out.unionByName(least.select(F.col("_n").alias("src"), F.col("least").alias("dst")))
    return out.filter(F.col("src") != F.col("dst")).distinct()


def components(edges: DataFrame, label: str = "components", max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (src long, dst long) that is not itself the smallest.

    Nulls and loops are ignored; repeated edges do no harm. Edges are contracted within their tasks first; what is left is
    contracted in one task if it is at most CHUNK edges. Otherwise each round contracts within the tasks, then does a large-star and a
    small-star step, and is written to the shared folder; the number of rounds grows with the logarithm of the longest
    chain. It ends when the edges are stars. Raises if ``max_rounds`` do not suffice, rather than give a part."""
    edges = edges.select(F.col(edges.columns[0]).cast("long").alias("src"), F.col(edges.columns[1]).cast("long").alias("dst")).dropna().filter("src != dst")
    edges = stage(contracted(edges), label)
    if edges.limit(CHUNK + 1).count() <= CHUNK:
        edges = stage(contracted(edges.coalesce(1)), label)
    else:
        for _ in range(max_rounds):
            edges = edges.coalesce(max(1, edges.rdd.getNumPartitions() // 2))
            edges = stage(_star(_star(contracted(edges), True), False), label)
            if _stars(edges):
                break
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: each component is a star around its smallest node."""
    rows, nodes = edges.agg(F.count("*"), F.countDistinct("src")).first()
    return rows == nodes and not edges.join(edges.select(F.col("src").alias("_r")), F.col("dst") == F.col("_r"), "left_semi").limit(1).count()
