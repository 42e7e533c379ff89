"""Logs, fees, layers, histories, paging and metric statistics as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TOPICS, MAX_SUBTOPICS = 4, 1000


def check_criteria(first=None, last=None, block_hash=None, topics=()) -> None:
    """A range or a block hash, not both; a range that doesn't run backwards; bounded topics."""
    if block_hash is not None and (first is not None or last is not None):
        raise ValueError("a block hash excludes a range")
    if first is not None and last is not None and 0 <= last < first:
        raise ValueError("the range ends before it begins")
    if len(topics) > MAX_TOPICS or any(len(t or ()) > MAX_SUBTOPICS for t in topics):
        raise ValueError("too many topics")


def log_filter(logs: DataFrame, first=None, last=None, addresses=(), topics=()) -> DataFrame:
    """Logs in a block range, of one of the addresses, and with one of topics[i] at place i; empty matches anything there is at that place."""
    check_criteria(first, last, None, topics)
    keep = F.size("topics") >= len(topics)
    for c in [F.col("block_number") >= first] * (first is not None) + [F.col("block_number") <= last] * (last is not None) + [F.col("address").isin(*addresses)] * bool(addresses):
        keep = c & keep
    for i, t in enumerate(topics):
        keep = keep & F.get("topics", F.lit(i)).isin(*t) if t else keep
    return logs.where(keep)


def deaccumulate(rows: DataFrame, value: str, block: str, order: list[str]) -> Column:
    return F.col(value) - F.lag(value, 1, 0).over(Window.partitionBy(block).orderBy(*order))


def weighted_percentiles(txs: DataFrame, percents: tuple[int, ...]) -> DataFrame:
    """(block_number, p, reward): the reward at which gas, cheapest first, reaches p % of the block's; its largest if none does."""
    by = Window.partitionBy("block_number")
    cum = txs.withColumn("cum", F.sum("gas_used").over(by.orderBy("reward", "tx_hash"))).withColumn("all", F.sum("gas_used").over(by))
    each = cum.withColumn("p", F.explode(F.array(*map(F.lit, percents))))
    reached = F.min(F.when(F.col("cum") >= F.floor(F.col("all") * F.col("p") / 100), F.col("reward")))
    return each.groupBy("block_number", "p").agg(F.coalesce(reached, F.max("reward")).alias("reward"))


def newest(layers: DataFrame, keys: list[str], order: str, gone: Column | None = None) -> DataFrame:
    """The row of the newest layer for each key; keys whose newest row is a tombstone have none."""
    rest = [c for c in layers.columns if c not in keys]
    out = layers.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    out = out.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return out if gone is None else out.where(~gone)


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of b that a lacks, each once."""
    return b.subtract(a)


def intervals(changes: DataFrame, keys: list[str], at: str, start: int) -> DataFrame:
    """changes with valid_from: a value holds from the change before (or start) to its own."""
    return changes.withColumn("valid_from", F.lag(at, 1, start).over(Window.partitionBy(*keys).orderBy(at)))


def keyset_page(rows: DataFrame, key: str, start, n: int) -> DataFrame:
    """n rows from key start on, with next_key, the key that the next page starts at (null on the last)."""
    page = rows.where(F.col(key) >= start).orderBy(key).limit(n + 1)
    numbered = page.withColumn("_i", F.row_number().over(Window.orderBy(key)))  # n + 1 rows
    return numbered.withColumn("next_key", F.max(F.when(F.col("_i") == n + 1, F.col(key))).over(Window.partitionBy(F.lit(1)))).where(F.col("_i") <= n).drop("_i")


def byte_capped(rows: DataFrame, key: str, size: Column, cap: int, start, most: int) -> DataFrame:
    """Rows from start on, most of them at the utmost, up to the one that takes the sum of sizes over cap."""
    page = rows.where(F.col(key) >= start).orderBy(key).limit(most)
    before = F.coalesce(F.sum(size).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return page.withColumn("_b", before).where(F.col("_b") <= cap).drop("_b")


def prefix_scan(rows: DataFrame, key: str, prefix: str, start: str = "") -> DataFrame:
    return rows.where(F.col(key).startswith(prefix) & (F.col(key) >= prefix + start))


def percentile_points(values: DataFrame, group: str, value: str, ps: tuple[float, ...]) -> DataFrame:
    """(group, p, v) at position p * (n + 1): the first below 1, the last from n on, else linear between neighbours.

    Values are counted first, so equal ones cost a row.
    """
    by = Window.partitionBy(group)
    cum = values.groupBy(group, value).agg(F.count("*").alias("k")).withColumn("hi", F.sum("k").over(by.orderBy(value))).withColumn("n", F.sum("k").over(by))
    cum = cum.withColumn("lo", F.col("hi") - F.col("k") + 1).withColumn("p", F.explode(F.array(*map(F.lit, ps))))
    pos = F.col("p") * (F.col("n") + 1)
    at = lambda i: F.max(F.when((F.col("lo") <= i) & (i <= F.col("hi")), F.col(value)))
    low = F.least(F.greatest(F.floor(pos), F.lit(1)), F.col("n"))
    high = F.least(low + 1, F.col("n"))
    frac = F.max(F.when((pos < 1) | (pos >= F.col("n")), 0.0).otherwise(pos - F.floor(pos)))
    return cum.groupBy(group, "p").agg((at(low) + frac * (at(high) - at(low))).alias("v"))


def ready(rows: DataFrame, account: str, nonce: str, first: int) -> DataFrame:
    """Rows of each account whose nonces run from first without a gap."""
    distinct = rows.select(account, nonce).distinct().where(F.col(nonce) >= first)
    return distinct.withColumn("_i", F.row_number().over(Window.partitionBy(account).orderBy(nonce)) - 1 + first).where(F.col("_i") == F.col(nonce)).drop("_i")


def ewma(ticks: DataFrame, group: str, tick: str, count: str, seconds: float, minutes: float) -> DataFrame:
    """(group, rate): moving rate after the last tick; the first tick sets it, each later one moves it by alpha."""
    import math

    alpha = 1 - math.exp(-seconds / 60 / minutes)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(tick, count))), lambda x: x[count] / seconds)
    rate = F.aggregate("r", F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(s + alpha * (x - s)))
    return ticks.groupBy(group).agg(ordered.alias("r")).select(group, rate.alias("rate"))


def uniform_sample(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows, all sets of n alike likely; the hash of key draws, so reruns agree."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def decaying_sample(rows: DataFrame, n: int, seed: int, seconds: Column, alpha: float, *key: str) -> DataFrame:
    """n rows of largest exp(alpha * seconds) / u, in logarithms, u drawn by the hash of key."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) + 1) / float(1 << 52)
    return rows.orderBy((alpha * seconds - F.log(u)).desc(), *key).limit(n)
