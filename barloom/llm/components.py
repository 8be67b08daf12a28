"""Connected components of a graph given by its links, by alternating large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint

#: Up to so many links are resolved by one task at once: 160 KB, and rounds would cost more than the work.
AT_ONCE = 10_000


class Forest:
    """Union-find; keeps the links that joined two trees."""

    def __init__(self):
        self.above: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        """Put two in one tree, named by its smallest; whether they weren't before."""
        x, y = self.root(a), self.root(b)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y

    def link(self, a: int, b: int) -> None:
        if self.join(a, b):
            self.links.append((a, b))


def _at_once(batches):
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.join(a, b)
    rows = [(x, forest.root(x)) for x in list(forest.above)]
    rows = [(x, r) for x, r in rows if x != r]
    yield pa.RecordBatch.from_pydict({"node": pa.array([x for x, _ in rows], pa.int64()), "root": pa.array([r for _, r in rows], pa.int64())})


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of links (a, b) with the smallest node reachable; a row for each node that isn't its own root.

    Each round replaces links by links to smaller nodes and keeps what is connected; it ends when nothing changes. Every
    round cuts its lineage with checkpoints. The smallest neighbours are written before they are joined, so that both
    sides of each join are plain tables: a node with very many neighbours is then a skewed key, which Spark splits. Null
    ends and loops don't count.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = checkpoint(edges.distinct())
    seen = _sum(edges)
    if seen[0] <= AT_ONCE:
        return checkpoint(edges.coalesce(1).mapInArrow(_at_once, "node long, root long"))
    while True:
        # Large star: what is larger than a node is linked to the smallest of its neighbours and itself.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(checkpoint(least), F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = checkpoint(large.distinct())
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m"))
        small = large.join(least, F.col("a") == F.col("c")).select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        edges = checkpoint(small.distinct())
        now = _sum(edges)
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
