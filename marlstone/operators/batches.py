"""Parts of a trace or chain by block: explicit batches, start block, block tags, ranges of a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# First and last block of each batch of the co-access runs.
BATCHES = (
    (20500000, 20599999), (20600000, 20759721), (20759722, 20884721), (20884722, 21009721),
    (21009722, 21134723), (21134724, 21259722), (21259723, 21379861), (21379862, 21500000),
)
# Numbers that stand for a block.
TAGS = {"earliest": 0, "pending": -1, "latest": -2, "finalized": -3, "safe": -4}
#: More batches than this aren't broadcast.
MOST_BATCHES = 10_000


def batch_table(spark: SparkSession, ranges=BATCHES) -> DataFrame:
    """(batch, first, last) of (first, last) ranges that don't overlap, both ends included."""
    if any(a > b for a, b in ranges) or any(a[1] >= b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:])):
        raise ValueError("batches overlap or run backwards")
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "batch long, first long, last long")


def in_batches(rows: DataFrame, batches: DataFrame, block: str = "block_id", whole: bool = True) -> DataFrame:
    """rows with `batch`; those outside all batches go. If whole, so do batches whose first or last block isn't among the rows.

    The batches are broadcast if there are at most MOST_BATCHES; the join is by range.
    """
    few = batches.limit(MOST_BATCHES + 1).count() <= MOST_BATCHES
    spread = F.broadcast(batches) if few else batches
    found = rows.join(spread, F.col(block).between(F.col("first"), F.col("last")))
    if whole:
        ends = F.max(F.col(block) == F.col("first")) & F.max(F.col(block) == F.col("last"))
        complete = found.groupBy("batch").agg(ends.alias("_whole")).where("_whole").select("batch")
        found = found.join(F.broadcast(complete) if few else complete, "batch", "left_semi")
    return found.drop("first", "last")


def from_block(rows: DataFrame, start: int, block: str = "block_id") -> DataFrame:
    """Rows from block `start` on, exactly; rows before any block marker (null) go."""
    return rows.where(F.col(block) >= start)


def heads(blocks: DataFrame, safe_lag: int, final_lag: int, block: str = "block_number") -> DataFrame:
    """One row (latest, safe, finalized) of a chain whose last blocks aren't safe or final yet."""
    top = F.max(block)
    return blocks.agg(top.alias("latest"), F.greatest(top - safe_lag, F.lit(0)).alias("safe"), F.greatest(top - final_lag, F.lit(0)).alias("finalized"))


def resolve(tag: int | str, head: dict[str, int]) -> int:
    """The block that a number or tag stands for; head holds latest, safe and finalized. A tag whose block is missing is an error."""
    number = TAGS[tag] if isinstance(tag, str) else tag
    if number >= 0:
        return number
    name = {-1: "latest", -2: "latest", -3: "finalized", -4: "safe"}.get(number)
    if name is None or head.get(name) is None:
        raise ValueError(f"no block for {tag}")
    return head[name]


def log_range(logs: DataFrame, head: dict[str, int], first: int | str, last: int | str) -> DataFrame:
    """Logs between two numbers or tags, both included. Pending blocks have no logs to ask for: an error."""
    if TAGS["pending"] in (TAGS.get(first, first), TAGS.get(last, last)):
        raise ValueError("pending logs aren't supported")
    return logs.where(F.col("block_number").between(resolve(first, head), resolve(last, head)))


def store_range(items: DataFrame, kind: str, start: int, count: int, most_bytes: int = 0) -> DataFrame:
    """items (kind, number, data) of a kind: up to `count` from `start` on in unbroken order, and, if most_bytes, as many as fit, at least one."""
    page = items.where((F.col("kind") == kind) & F.col("number").between(start, start + count - 1))
    by = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # count rows at most
    page = page.withColumns({"_sum": F.sum(F.octet_length("data")).over(by), "_nth": F.row_number().over(Window.orderBy("number"))})
    page = page.where(F.col("number") == F.col("_nth") + start - 1)
    fits = (F.col("_nth") == 1) | (F.col("_sum") <= most_bytes) if most_bytes else F.lit(True)
    return page.where(fits).drop("_sum", "_nth")


def headers_back(headers: DataFrame, number: int, count: int) -> DataFrame:
    """Up to `count` canonical headers (number, hash, parent, canonical) that end at `number`."""
    return headers.where(F.col("canonical") & F.col("number").between(number - count + 1, number))


def hashes_in_range(headers: DataFrame, first: int, last: int) -> DataFrame:
    """(number, hash) of all headers, canonical or not, in a range."""
    return headers.where(F.col("number").between(first, last)).select("number", "hash")


def canonical_hashes(headers: DataFrame, first: int, end: int, limit: int) -> DataFrame:
    """(number, hash) of canonical headers from first up to, but without, end; the first `limit` of them."""
    return headers.where(F.col("canonical") & (F.col("number") >= first) & (F.col("number") < end)).orderBy("number").limit(limit).select("number", "hash")


def prefixed(rows: DataFrame, key: str, prefix: Column | str) -> DataFrame:
    """The part of a store under a prefix, which is taken off its keys."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return rows.where(F.startswith(F.col(key), p)).withColumn(key, F.substr(F.col(key), F.length(p) + 1))
