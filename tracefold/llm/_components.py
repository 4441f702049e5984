"""Connected components of an edge list, each node with the smallest node it reaches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Up to so many edges (16 bytes each) one task joins them by union-find; beyond, stars are contracted in rounds.
EDGES_IN_ONE_TASK = 2_000_000


def components(edges: DataFrame, in_one_task: int = EDGES_IN_ONE_TASK) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``a`` and ``b``, long, undirected, not null)."""
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return _by_union(edges) if edges.count() <= in_one_task else _by_stars(edges)


def _by_union(edges: DataFrame) -> DataFrame:
    def run(batches):
        parent: dict[int, int] = {}

        def find(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = sorted((find(a), find(b)))
                parent[b] = a
        nodes = list(parent)
        for at in range(0, len(nodes), 65_536):
            part = nodes[at : at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def _by_stars(edges: DataFrame) -> DataFrame:
    """Large-star and small-star rounds; a hub's rows are joined, never gathered, so skewed hubs can be split."""
    stars = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # u > v
    while True:
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = cut(small.filter("u <> v").distinct())
        digest = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if small.agg(digest).first() == stars.agg(digest).first():
            roots = small.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
        stars = small
