"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The top of the tree is fitted on a bounded sample and every row is filed under a
leaf. Leaves with many rows get subtrees, fitted in executors on bounded samples of
their own rows, so that the number of leaves follows that of rows: the work of a
query stays the same up to LEAF_ROWS * MOST_BYTES / 8d rows (4 million of 128 dimensions);
from there on leaves grow, for the tree is broadcast and so must be bounded.

A query walks the tree with a priority queue of nodes by distance to their centre
and visits leaves in that order. How many it visits is found by widening, a leaf at
a time, until the true neighbours of a few calibration queries, found by brute force
over all rows, are reached. Of rows with the same vector only the k + 1 smallest ids
can be among any query's k nearest, so the rest needn't be filed; other large
leaves are cut into chunks.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Rows that the tree is fitted on, children of a node, and rows of the sample in a leaf.
SAMPLE, BRANCHES, LEAF = 20_000, 16, 96
#: Rows of the table for each leaf, bytes of all centres, leaves of a subtree, rows of a subtree's sample for each leaf, and rounds of growth, at most.
LEAF_ROWS, MOST_BYTES, SUBTREE, SUBSAMPLE, ROUNDS = 512, 1 << 23, 2048, 24, 4
#: Calibration queries, and the recall that they must reach.
CALIBRATION, RECALL = 128, 0.98
#: Rows of a leaf that are compared in one piece.
CHUNK = 8192
OUT = "query_id long, rank int, vec_id long, score double"


class Tree:
    """centres[i] and children[i] of node i; the root is 0, a node without children is a leaf."""

    def __init__(self, centres: np.ndarray, children: list[list[int]]):
        self.centres, self.children = centres, children

    @property
    def leaves(self) -> int:
        return sum(not c for c in self.children)

    def graft(self, leaf: int, centres: np.ndarray, children: list[list[int]]) -> None:
        """Put a subtree, its own root at 0, in place of a leaf."""
        base = len(self.centres) - 1  # the root of the subtree is the leaf itself
        self.children[leaf] = [c + base for c in children[0]]
        self.children += [[c + base for c in below] for below in children[1:]]
        self.centres = np.concatenate([self.centres, centres[1:]])

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 7, leaf: int | None = None) -> Tree:
        leaf = leaf or LEAF
        random = np.random.default_rng(seed)
        centres, children, todo = [x.mean(0)], [[]], [(0, x)]
        while todo:
            node, rows = todo.pop()
            k = min(BRANCHES, len(rows) // leaf)
            if k < 2:
                continue
            c, own = kmeans(rows, k, random)
            if len(c) < 2:
                continue
            for i in range(len(c)):
                children[node].append(len(centres))
                todo.append((len(centres), rows[own == i]))
                centres.append(c[i])
                children.append([])
        return cls(np.array(centres), children)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the nearest centres."""
        at, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                at[rows] = node
                continue
            own = nearest(x[rows], self.centres[self.children[node]])
            todo += [(c, rows[own == i]) for i, c in enumerate(self.children[node]) if (own == i).any()]
        return at

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue, order = [(0.0, 0, 0)], itertools.count(1)
        while queue:
            _, _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield node
                continue
            for c, d in zip(self.children[node], ((self.centres[self.children[node]] - q) ** 2).sum(1).tolist(), strict=True):
                heapq.heappush(queue, (d, next(order), c))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def kmeans(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres that have rows, and each row's."""
    c = x[random.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        used, own = np.unique(own, return_inverse=True)
        n = np.bincount(own)
        c = np.stack([np.bincount(own, x[:, j]) for j in range(x.shape[1])], 1) / n[:, None]
    own = nearest(x, c)
    used, own = np.unique(own, return_inverse=True)
    return c[used], own


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, d)


def closest(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (row of q, its own id): (i, ids, distances) of its k nearest, exact, ties to the smaller id; an id that repeats counts once, at its nearest."""
    norms, repeats = (x**2).sum(1), len(np.unique(ids)) < len(ids)
    rough = (q**2).sum(1)[:, None] + norms - 2 * q @ x.T
    for i in range(len(q)):
        r = np.where(ids == own[i], np.inf, rough[i])
        if len(r) > k and not repeats:
            limit = np.partition(r, k - 1)[k - 1]
            at = np.flatnonzero(r <= limit + 1e-9 * (1 + abs(limit) + norms.max()))
        else:
            at = np.arange(len(r))
        at = at[ids[at] != own[i]]
        dist = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
        best = np.lexsort((ids[at], dist))
        if repeats:
            best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])]
        best = best[:k]
        yield i, ids[at][best], dist[best]


def valid(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) of usable rows, v in double precision, and their dimension: the most frequent one (the smaller of two)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & sound)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (most[0] if most else 0)), most[0] if most else 0


def brute_force(rows: DataFrame, d: int, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, dist, v) of a bounded set of queries against all rows, k for each task."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best: list[list] = [[] for _ in ids]
        for b in batches:
            x, own = matrix(b.column(1), d), b.column(0).to_numpy()
            for at in range(0, len(x), CHUNK):
                for i, found, dist in closest(q, ids, x[at : at + CHUNK], own[at : at + CHUNK], k):
                    where = {v: p for p, v in enumerate(own[at : at + CHUNK].tolist())}
                    best[i] = sorted(best[i] + [(s, v, x[at + where[v]]) for s, v in zip(dist.tolist(), found.tolist(), strict=True)], key=lambda r: r[:2])[:k]
        out = [(int(ids[i]), v, s, list(x)) for i, rows in enumerate(best) for s, v, x in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())), strict=True)], ["query_id", "vec_id", "dist", "v"])

    return rows.mapInArrow(run, "query_id long, vec_id long, dist double, v array<double>")


def calibrate(rows: DataFrame, d: int, tree: Tree, k: int, sample: list) -> int:
    """Leaves to visit: one more at a time, until RECALL of the true neighbours of the sample are reached."""
    ids, q = np.array([r[0] for r in sample]), np.array([r[1] for r in sample])
    top = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    truth = brute_force(rows, d, ids, q, k).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "v").collect()
    wanted: dict[int, Counter] = {int(i): Counter() for i in ids}
    for r, leaf in zip(truth, tree.file(np.array([r.v for r in truth])).tolist() if truth else [], strict=True):
        wanted[r.query_id][leaf] += 1
    walks = [(tree.visit(x), wanted[int(i)]) for i, x in zip(ids, q, strict=True)]
    reached, visits = 0, 0
    while reached < RECALL * len(truth):
        visits += 1
        reached += sum(left[leaf] for walk, left in walks if (leaf := next(walk, None)) is not None)
    return max(1, visits)


def filer(tree: Tree, d: int, spark):
    """A pass (vec_id, v) -> (leaf, id, v)."""
    shared = spark.sparkContext.broadcast((tree.centres, tree.children))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.file(matrix(b.column(1), d))), b.column(0), b.column(1)], ["leaf", "id", "v"])

    return run


FILED = "leaf long, id long, v array<double>"


def drawn(share: Column) -> Column:
    """Whether a row of `id` is in a sample of about this share of all rows."""
    return F.pmod(F.xxhash64("id", F.lit("tree")), F.lit(1_000_003)) < share * 1_000_003


def grow(tree: Tree, rows: DataFrame, d: int, total: int) -> tuple[Tree, DataFrame]:
    """The tree with about a leaf for every LEAF_ROWS rows, and rows as FILED in it."""
    spark, most = rows.sparkSession, MOST_BYTES // (8 * d)

    def split(key, table):
        part = Tree.fit(matrix(table.column("v").combine_chunks(), d), int(key[0].as_py()), SUBSAMPLE)
        below = [part.children] if part.children[0] else []
        made = {"leaf": [key[0].as_py()] * len(below), "centres": [part.centres.tobytes()] * len(below), "children": below}
        return pa.table({k: pa.array(made[k], t) for k, t in (("leaf", pa.int64()), ("centres", pa.binary()), ("children", pa.list_(pa.list_(pa.int64()))))})

    for _ in range(ROUNDS):
        filed = checkpointed(rows.mapInArrow(filer(tree, d, spark), FILED))
        wanted = min(most, total // LEAF_ROWS)
        sizes = filed.groupBy("leaf").agg(F.count("*").alias("n"))
        share = F.least(F.ceil(F.col("n") * (wanted / max(1, total))), F.lit(SUBTREE))
        large = sizes.where(F.col("n") >= 4 * LEAF_ROWS).select("leaf", (share * SUBSAMPLE / F.col("n")).alias("share"))
        if tree.leaves >= wanted or not large.limit(1).count():
            break
        # a row for each leaf: as many as the tree has, which MOST_BYTES bounds; as are the subtrees collected
        subtrees = filed.join(F.broadcast(large), "leaf").where(drawn(F.col("share"))).select("leaf", "v").groupBy("leaf").applyInArrow(split, "leaf long, centres binary, children array<array<long>>").collect()
        for r in sorted(subtrees, key=lambda r: r.leaf):
            tree.graft(r.leaf, np.frombuffer(r.centres).reshape(-1, d), [list(c) for c in r.children])
        if not subtrees:
            break
    else:
        filed = checkpointed(rows.mapInArrow(filer(tree, d, spark), FILED))
    return tree, filed


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of vectors found for each row of queries, by Euclidean distance.

    Both: vec_id, embedding; other columns are ignored. A row of the query's own
    vec_id is no candidate. Vectors that are null, zero, of a rarer dimension or hold
    null or non-finite components take no part, nor do rows of null vec_id. Equal
    distances go to the smaller vec_id; a vec_id that repeats is found once, at its
    nearest vector, and of queries that repeat one the smallest vector is taken. Queries
    without candidates, and empty tables, give no rows. With fewer than k candidates
    in the leaves visited, all leaves are visited.
    """
    spark = vectors.sparkSession
    rows, d = valid(vectors.where(F.col("vec_id").isNotNull()))
    if not d:
        return spark.createDataFrame([], OUT)
    hashed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})  # 128 bits stand for a vector
    twins = Window.partitionBy("h1", "h2").orderBy("vec_id")
    distinct = hashed.dropDuplicates(["vec_id", "h1", "h2"])
    rows = checkpointed(distinct.withColumn("n", F.row_number().over(twins)).where(F.col("n") <= k + 1).select("vec_id", "v"))
    total = rows.count()
    share = F.pmod(F.xxhash64("vec_id", F.lit("tree")), F.lit(1_000_003)) < int(1_000_003 * min(1.0, SAMPLE / total)) + 1
    sample = rows.where(share).orderBy(F.xxhash64("vec_id", F.lit("order")), "vec_id", "v").limit(SAMPLE).collect()
    sample = sample or rows.orderBy("vec_id", "v").limit(SAMPLE).collect()
    tree, filed = grow(Tree.fit(np.array([r.v for r in sample])), rows, d, total)
    visits = calibrate(rows, d, tree, k, sample[:CALIBRATION])
    sizes = checkpointed(filed.groupBy("leaf").agg(F.count("*").alias("n")))  # a row for each leaf
    held_by = {r[0]: r[1] for r in sizes.collect()}
    shared = spark.sparkContext.broadcast((tree.centres, tree.children, held_by))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, children, held_by = shared.value
        tree = Tree(centres, children)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                paths = [walk_one(tree, held_by, q) for q in matrix(part.column(1), d)]
                take = pa.array(np.repeat(np.arange(len(paths)), [len(p) for p in paths]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths)), part.column(0).take(take), part.column(1).take(take)], ["leaf", "id", "v"])

    def walk_one(tree: Tree, held_by: dict[int, int], q: np.ndarray) -> np.ndarray:
        found, held = [], 0
        for nth, leaf in enumerate(tree.visit(q)):
            if nth >= visits and held > k:
                break
            if leaf in held_by:
                found.append(leaf)
                held += held_by[leaf]
        return np.array(found, np.int64)

    chunks = F.broadcast(sizes.select("leaf", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    asked, _ = valid(queries.where(F.col("vec_id").isNotNull()))
    asked = asked.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.mapInArrow(walk, FILED).join(chunks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("asks"), "id", "v")
    base = filed.join(chunks, "leaf").select("leaf", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), F.lit(0).alias("asks"), "id", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, ids = None, [], []
        for b in batches:
            leaf, chunk, asks = (b.column(c).to_numpy() for c in range(3))
            edges = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(chunk) != 0) | (np.diff(asks) != 0)) + 1
            for low, high in itertools.pairwise([0, *edges.tolist(), b.num_rows]):
                if (leaf[low], chunk[low]) != at:
                    at, x, ids = (leaf[low], chunk[low]), [], []
                rows, own = matrix(b.column(4).slice(low, high - low), d), b.column(3).slice(low, high - low).to_numpy()
                if not asks[low]:
                    x.append(rows)
                    ids.append(own)
                elif x:
                    x, ids = [np.concatenate(x)], [np.concatenate(ids)]
                    for start in range(0, len(rows), 256):
                        found = [(own[start + i], v, s) for i, v, s in closest(rows[start : start + 256], own[start : start + 256], x[0], ids[0], k)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "vec_id", "score"])

    dealt = base.unionByName(asked).repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "asks")
    found = dealt.mapInArrow(compare, "query_id long, vec_id long, score double")
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
