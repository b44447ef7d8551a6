"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import checkpoint

#: Edges, at most, that one task joins (16 MB); more go through the distributed rounds, with the same result.
ONE_TASK = 1 << 20


def again(column: str) -> Column:
    """The same number as an expression: a join on it shuffles its side after the aggregation, and so Spark may split a
    node with very many edges on the other side."""
    return F.bitwise_not(F.bitwise_not(column))


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges u, v to node, root, by union and find; the smaller node is the root."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := top.setdefault(root, root)) != root:
            root = up
        while x != root:
            top[x], x = root, top[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            top[max(a, b)] = min(a, b)
    nodes = list(top)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(find, nodes)), pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """edges: u, v (long). Returns node, root (smallest node reachable) for each node that has an edge to another.

    Up to one_task edges are joined in one task on an executor. Beyond that rounds are distributed:
    Both steps group with partial aggregation, so a node with very many edges is one row per task. Each round is
    checkpointed; nothing but its count and checksum comes to the driver. O(log^2 n) rounds, few in practice.
    """
    e = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = (e.count(), None)
    if before[0] <= one_task:
        return checkpoint(e.coalesce(1).mapInArrow(joined, "node long, root long"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(again("u").alias("of"), "m")
        large = both.join(least, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.select(again("u").alias("of"), "m"), F.col("u") == F.col("of")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # a step never has more edges than the one before, so its count bounds the next one's files
        e = checkpoint(e, before[0])
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
