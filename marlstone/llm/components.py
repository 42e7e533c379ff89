"""Connected components of an edge table: union-find inside partitions of so many edges, star contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_keys


#: Edges that one task joins by union-find; so many and fewer need no contraction.
TASK_EDGES = 50_000


class UnionFind(dict):
    def find(self, x: int) -> int:
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges (u, v) as stars: u joined to the smallest node it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sets.union(u, v)
        pairs = [(u, sets.find(u)) for u in list(sets)]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v) that isn't its component's smallest; component is that one. Edges are read twice: checkpoint them."""
    tasks = -(-edges.count() // TASK_EDGES)
    edges, before = checkpointed(forest(edges.coalesce(max(1, tasks)))), None
    if tasks <= 1:
        return edges.toDF("node", "component")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = checkpointed(join_keys(both.where("v > u"), low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = checkpointed(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_keys(large, low, "u", "n")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
