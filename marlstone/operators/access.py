"""Counts, distributions, updates, sizes and co-access of key-value operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.categories import bucket
from marlstone.functions.checkpoints import checkpointed

DISTANCES = (0, 1, 4, 16, 64, 256, 1024)


def batch_of(block: Column, start: int, step: int) -> Column:
    """Batch k holds (start + k * step, start + (k + 1) * step]; the first also start itself."""
    return F.greatest(F.lit(0), F.ceil((block - start) / step) - 1).cast("long")


def op_counts(trace: DataFrame, *by: str) -> DataFrame:
    return trace.groupBy(*by, "category", "op_type").agg(F.count("*").alias("n"))


def key_counts(trace: DataFrame, *by: str) -> DataFrame:
    """Accesses of each key by category and bucket; operations without a bucket have none."""
    return trace.withColumn("bucket", bucket(F.col("op_type"))).where(F.col("bucket").isNotNull()).groupBy(*by, "category", "bucket", "key").agg(F.count("*").alias("n"))


def ranked(counts: DataFrame, group: list[str], least_keys: int = 1) -> DataFrame:
    """id by count, largest first, then key; only groups of least_keys keys or more. Numbers a group in one task; see ranked_wide."""
    whole = Window.partitionBy(*group)
    out = counts.withColumn("id", F.row_number().over(whole.orderBy(F.desc("n"), "key")).cast("long"))
    return out if least_keys <= 1 else out.withColumn("_k", F.count("*").over(whole)).where(F.col("_k") >= least_keys).drop("_k")


def ranked_wide(counts: DataFrame, group: list[str], least_keys: int = 1) -> DataFrame:
    """As ranked, for groups of any size: ranges of the sorted whole are numbered by themselves, then moved on by what lies before them."""
    order = [F.desc("n"), F.asc("key")]
    ranged = checkpointed(counts.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    inside = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order)))
    sizes = ranged.groupBy("_range", *group).agg(F.count("*").alias("_k"))  # a row for each range and group in it
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    if least_keys > 1:
        moved = moved.withColumn("_all", F.sum("_k").over(Window.partitionBy(*group))).where(F.col("_all") >= least_keys).drop("_all")
    moved = moved.drop("_k")
    return inside.join(moved, ["_range", *group]).withColumn("id", F.col("_i") + F.col("_before")).drop("_range", "_i", "_before")


def classify_updates(trace: DataFrame, snapshot: DataFrame) -> DataFrame:
    """trace with new_op: a Put or BatchPut is an Update if its key is in snapshot (key) or was written before."""
    write = F.col("op_type").isin("Put", "BatchPut")
    held = snapshot.select("key").distinct().withColumn("_held", F.lit(True))
    first = trace.where(write).groupBy("key").agg(F.min("seq").alias("_first"))
    joined = trace.join(first, "key", "left").join(held, "key", "left")
    update = write & (F.coalesce("_held", F.lit(False)) | (F.col("seq") > F.col("_first")))
    return joined.withColumn("new_op", F.when(update, "Update").otherwise(F.col("op_type"))).drop("_held", "_first")


def size_summary(kv: DataFrame, by: str) -> DataFrame:
    """Counts and sizes in bytes of keys and values."""
    k, v = F.octet_length("key"), F.octet_length("value")
    least = {f"{f.__name__}_{n}": f(x).cast("long") for f in (F.min, F.max) for n, x in (("key", k), ("value", v), ("kv", k + v))}
    return kv.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(k + v) / F.count("*"), 2).alias("avg_kv"), *[c.alias(n) for n, c in least.items()])


def min_after_zero(kv: DataFrame, by: str) -> DataFrame:
    """The minimum as kept by a scan in key order that takes 0 for unset: of the values after the last empty one, else 0."""
    v = F.octet_length("value").cast("long")
    rows = kv.select(by, "key", v.alias("size"))
    last = rows.where("size = 0").groupBy(by).agg(F.max("key").alias("_last"))
    return rows.join(last, by, "left").groupBy(by).agg(F.coalesce(F.min(F.when(F.col("_last").isNull() | (F.col("key") > F.col("_last")), F.col("size"))), F.lit(0)).alias("min_value"))


def size_histogram(kv: DataFrame, by: str, size: Column, width: int) -> DataFrame:
    """Rows by bucket of width, with zeros between a group's least and largest bucket."""
    found = kv.withColumn("bucket", (F.floor(size / width) * width).cast("long")).groupBy(by, "bucket").agg(F.count("*").alias("n"))
    span = found.groupBy(by).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    all_ = span.select(by, F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("bucket"))
    return all_.join(found, [by, "bucket"], "left").select(by, "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def neighbours(rows: DataFrame, distances=DISTANCES) -> DataFrame:
    """(distance, segment_id, k1, k2): rows (segment_id, seq, key) paired with the one distance + 1 before; one pass for all distances."""
    by = Window.partitionBy("segment_id").orderBy("seq")
    lags = F.array(*[F.struct(F.lit(d).alias("distance"), F.lag("key", d + 1).over(by).alias("other")) for d in distances])
    pairs = rows.select(*rows.columns, lags.alias("_l")).select("*", F.inline(F.filter("_l", lambda x: x["other"].isNotNull()))).drop("_l")
    return pairs.withColumns({"k1": F.least("key", "other"), "k2": F.greatest("key", "other")}).drop("key", "other")


def pair_totals(pairs: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """freq of each pair by `by` and the number of its distinct blocks, without listing them: for pairs of any number of blocks."""
    per = pairs.groupBy(*by, "k1", "k2", "block_id").agg(F.count("*").alias("n"))
    return per.groupBy(*by, "k1", "k2").agg(F.sum("n").alias("freq"), F.count("*").alias("n_blocks")).where(F.col("freq") >= least)


def pair_counts(pairs: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """freq of each pair by `by`, and its distinct blocks in order; pairs rarer than `least` go. A pair's blocks are one value; see pair_totals."""
    out = pairs.groupBy(*by, "k1", "k2").agg(F.count("*").alias("freq"), F.array_sort(F.collect_set("block_id")).alias("blocks"))
    return out.where(F.col("freq") >= least)


def merge_pairs(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sums of freq and the blocks of all parts, none taken out."""
    return parts.groupBy(*by, "k1", "k2").agg(F.sum("freq").alias("freq"), F.array_sort(F.flatten(F.collect_list("blocks"))).alias("blocks"))


def category_pairs(pairs: DataFrame, by: list[str], total: bool = False) -> DataFrame:
    """freq of unordered pairs of categories (c1, c2); with total, a last row of nulls holds the sum."""
    both = pairs.select(*by, F.least("c1", "c2").alias("cat1"), F.greatest("c1", "c2").alias("cat2"), "freq")
    if not total:
        return both.groupBy(*by, "cat1", "cat2").agg(F.sum("freq").alias("freq"))
    return both.groupingSets([["cat1", "cat2"], []], "cat1", "cat2").agg(F.sum("freq").alias("freq"))


def grams(rows: DataFrame, n: int, group: str) -> DataFrame:
    """Counts of n neighbouring op_types by (group, seq); the first pair of a group has an empty left side."""
    by = Window.partitionBy(group).orderBy("seq")
    parts = [F.lag("op_type", i).over(by) for i in range(n - 1, 0, -1)]
    parts = [F.coalesce(parts[0], F.lit(""))] if n == 2 else parts
    text = rows.select(F.concat_ws("-", *parts, "op_type").alias("gram"), F.size(F.array_compact(F.array(*parts, F.lit("x")))).alias("k"))
    return text.where(F.col("k") == n).groupBy("gram").agg(F.count("*").alias("n"))
