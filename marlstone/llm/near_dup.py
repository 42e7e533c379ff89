"""Near-duplicate classes by SuperMinHash, banding, exact verification and union-find.

1. Each text becomes its set of word shingles, a signature, and a hash of each band
   of it. Texts of equal sets are one class from here on, so exact copies cost a row.
2. Classes that share a band are candidates. Small buckets give all their pairs;
   in a larger one each class is paired with the class of most copies. Signatures
   that are too unlike drop a pair; the others are checked on full sets.
3. Large buckets that still hold several components are taken up again in blocks:
   each class outside the largest component is compared with all of other
   components, on full sets through an inverted list, in one pass that joins
   components as it finds links and returns those links alone. A set of the largest
   component is copied once for each block of the rest, so the work grows with the
   part of a bucket that isn't joined yet. No group is ever expanded into its
   pairs, and none is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpointed, join_keys, mix, shingles, sliced, text_bytes
from .components import UnionFind, components
from .minhash import band_hashes, signatures

#: Slots of a signature and bands: a pair of similarity 0.75 shares none with a probability of 5e-6.
SLOTS, BANDS = 128, 32
#: A pair of similarity 0.75 is estimated lower than this with a probability of 1e-6.
ESTIMATE = 0.57
#: Buckets of up to so many classes give all pairs.
SMALL_BUCKET = 16
#: A larger bucket is cut into BLOCKS blocks, but a block holds about so many shingles at least, and BLOCKS times as many at most.
BLOCKS, BLOCK_SHINGLES = 16, 1 << 16
#: Up to so many classes in candidate pairs, their ids are broadcast.
BROADCAST_IDS = 1_000_000
ELEMENTS = 40_000


def shingle_sets(texts: list[bytes], width: int, hashes: WordHashes) -> list[np.ndarray]:
    return [np.unique(shingles(hashes.of(t.lower().split()), width)) for t in texts]  # bytes.lower() changes just A-Z


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, n_shingles, s1, s2, sig, bands): th hashes the text, s1 and s2 its set; sig has 16 bits a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches):
            ids, ths, texts = b.column(0), b.column(1), text_bytes(b.column(2))
            at = 0
            while at < len(texts):
                sets, n = [], 0
                while at + len(sets) < len(texts) and n < ELEMENTS:
                    sets += shingle_sets([texts[at + len(sets)]], width, hashes)
                    n += len(sets[-1])
                sizes = np.array([len(s) for s in sets], np.int64)
                sig = signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), SLOTS)
                short = (mix(sig.view(np.uint64)) >> np.uint64(48)).astype("<u2")
                whole = np.zeros((2, len(sets)), np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        whole[:, i] = mix(s).sum(), np.bitwise_xor.reduce(mix(s + np.uint64(7)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(sets)), ths.slice(at, len(sets)), pa.array(sizes), *map(pa.array, whole.view(np.int64)), pa.array([x.tobytes() for x in short], pa.binary()), pa.array(list(band_hashes(sig, BANDS)), pa.list_(pa.int64()))],
                    ["doc_id", "th", "n_shingles", "s1", "s2", "sig", "bands"],
                )
                at += len(sets)

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, s1 long, s2 long, sig binary, bands array<long>")


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ESTIMATE of the slots or more."""
    sig = nodes.select("node", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SLOTS) for c in (2, 3))
            keep = pa.array((x == y).mean(1) >= ESTIMATE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of wanted (node, doc_id, th), from the texts; shingles are sorted uint64."""
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = wanted.toDF("node", "id_", "th_")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = keyed.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches, 256):
            sets = [s.tobytes() for s in shingle_sets(text_bytes(b.column(1)), width, hashes)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return found.select("node", "text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def common_size(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted arrays share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * common >= percent * all shingles."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                n = common_size(x, y)
                keep.append(100 * n >= percent * (len(x) + len(y) - n))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "u long, v long")


def links_between(nodes: list[int], sets: list[np.ndarray], parts: list[int], asks: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links that join the parts, of all pairs of an asking node with one of another part; memory is that of the sets."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    by_word = np.argsort(word, kind="stable")
    posting, ends = owner[by_word], np.cumsum(np.bincount(word))
    begins = ends - np.bincount(word)
    first, part = np.cumsum(size) - size, np.array(parts)
    joined, found = UnionFind(), []
    for i in np.flatnonzero(asks).tolist():
        words = word[first[i] : first[i] + size[i]]
        n = ends[words] - begins[words]
        # where each posting of these words lies: one run of places after another
        at = np.repeat(begins[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if len(at) < len(sets):
            other, both = np.unique(posting[at], return_counts=True)
        else:
            both = np.bincount(posting[at], minlength=len(sets))
            other = np.flatnonzero(both)
            both = both[other]
        near = (100 * both >= percent * (size[i] + size[other] - both)) & (part[other] != part[i])
        for k in other[near].tolist():
            if joined.union(parts[i], parts[k]):
                found.append((nodes[i], nodes[k]))
    return found


def links_in_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join components inside each block; blocks: key, all, ask, asks, node, part, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len({g[2] for g in group}) > 1:
                found = links_between([g[1] for g in group], [g[3] for g in group], [g[2] for g in group], [g[0] for g in group], percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])
            group.clear()

        for b in sliced(batches):
            for *here, asks, node, part, shingle in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if here != at:
                    yield from close()
                    at = here
                group.append((asks, node, part, np.frombuffer(shingle, "<u8")))
        yield from close()

    ordered = blocks.repartition("key", "all", "ask").sortWithinPartitions("key", "all", "ask")
    return ordered.select("key", "all", "ask", "asks", "node", "part", "shingles").mapInArrow(run, "u long, v long")


def open_blocks(part: DataFrame) -> DataFrame:
    """The rows of buckets with several components, dealt to blocks: (key, all, ask, asks, node, part).

    part: key, node, n, part. A bucket's classes are cut into `alls` blocks, those
    outside its largest component, the asking ones, also into `n_asks` blocks of that
    size; each block of the one kind meets each of the other.
    """
    per = checkpointed(part.groupBy("key", "part").agg(F.count("*").alias("k"), F.sum("n").alias("n")))
    bucket = per.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("k").alias("k"), F.sum("n").alias("total"), (F.sum("n") - F.max("n")).alias("open"))
    size = F.least(F.greatest(F.col("total") / BLOCKS, F.lit(BLOCK_SHINGLES)), F.lit(BLOCKS * BLOCK_SHINGLES))
    blocks_of = lambda c: F.ceil(F.col(c) / size).cast("int")
    bucket = checkpointed(bucket.where("parts > 1").select("key", "main", "k", blocks_of("total").alias("alls"), blocks_of("open").alias("n_asks")))
    rows = join_keys(part.select("key", "node", "part"), bucket, "key", "k").withColumn("h", F.xxhash64("node"))
    mine = F.pmod("h", "alls").cast("int")
    told = rows.select("key", mine.alias("all"), F.explode(F.sequence(F.lit(0), F.col("n_asks") - 1)).alias("ask"), F.lit(False).alias("asks"), "node", "part")
    asking = rows.where("part != main").select("key", F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("all"), F.pmod(F.xxhash64("h"), "n_asks").cast("int").alias("ask"), F.lit(True).alias("asks"), "node", "part")
    return told.unionByName(asking)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept) of every row; th is xxhash64 of the text.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. Texts whose sets share
    percent % of all their shingles are linked. Null, empty or blank text has no
    shingles and no links. component_id is the smallest doc_id reached. Rows of null
    doc_id take part; they are kept only if their component has no doc_id (then
    component_id is null). Rows that repeat a doc_id are kept or not together if
    their texts are alike, else each by its own class. Other columns are ignored. An empty table gives none.
    """
    rows = checkpointed(signed(docs, width))
    classes = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("first"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig"), F.max("bands").alias("bands"))
    # The checkpoint fixes the numbers. A doc_id wouldn't do: classes of different texts may share one, or have none.
    nodes = checkpointed(classes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), "copies", "n", "sig", "bands"))

    member = nodes.select("node", "copies", "n", F.explode("bands").alias("key"))
    bucket = checkpointed(member.groupBy("key").agg(F.count("*").alias("k"), F.max_by("node", "copies").alias("hub")).where("k > 1"))
    member = checkpointed(join_keys(member.select("key", "node", "n"), bucket, "key", "k"))
    small = member.where(F.col("k") <= SMALL_BUCKET).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("x"))
    small = small.select("x", F.explode("x").alias("a")).select("a", F.explode(F.filter("x", lambda b: b > F.col("a"))).alias("b"))
    large = member.where(F.col("k") > SMALL_BUCKET)
    star = large.where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    pairs = checkpointed(alike(small.unionByName(star).distinct(), nodes))

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(large.select("node")).distinct()
    sets = checkpointed(full_sets(docs, checkpointed(nodes.join(wanted, "node").select("node", "doc_id", "th")), width))
    edges = checkpointed(linked(pairs, sets, percent))
    found = components(edges)

    part = checkpointed(large.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("part")))
    blocks = open_blocks(part).join(sets, "node")
    more = checkpointed(links_in_blocks(blocks, percent))
    if more.limit(1).count():
        found = components(checkpointed(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)))

    ids = found.unionByName(found.select(F.col("component").alias("node"), "component")).distinct().join(nodes.select("node", "doc_id"), "node")
    low = checkpointed(ids.groupBy("component").agg(F.min("doc_id").alias("low"), F.count("*").alias("k")))
    lowest = join_keys(ids.select("node", "component"), low, "component", "k").select("node", "low")
    final = checkpointed(nodes.select("s1", "s2", "node", "doc_id", "copies").join(lowest, "node", "left").select("s1", "s2", "copies", F.coalesce("low", "doc_id").alias("component_id")))
    plain = rows.select("doc_id", "th", "n_shingles", "s1", "s2")
    out = join_keys(plain.where("n_shingles > 0"), final, ["s1", "s2"], "copies").select("doc_id", "th", "n_shingles", "component_id")
    out = out.unionByName(plain.where("n_shingles = 0").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
