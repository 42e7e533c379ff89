"""Nonce maps, priority queues, iterators of nodes, fair mixes and state before a transaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.codecs import in_network


def forward(pool: DataFrame, thresholds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) of pool (account, nonce, ...): nonces below their account's `least` go; accounts without one keep all."""
    joined = pool.join(thresholds.select("account", "least"), "account", "left")
    below = F.coalesce(F.col("nonce") < F.col("least"), F.lit(False))
    return joined.where(~below).drop("least"), joined.where(below).drop("least")


def cap(pool: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): each account keeps its `most` smallest nonces."""
    ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy("account").orderBy("nonce")))
    return ranked.where(F.col("_r") <= most).drop("_r"), ranked.where(F.col("_r") > most).drop("_r")


def pool_content(pool: DataFrame, summary: Column) -> DataFrame:
    """(account, content): for each account a map nonce -> summary, in the order of nonces. An account's rows are one value."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("nonce").cast("string").alias("n"), summary.alias("s"), F.col("nonce").alias("o"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    return pool.groupBy("account").agg(F.map_from_entries(F.transform(entries, lambda x: F.struct(x["n"], x["s"]))).alias("content"))


def pop_until(queue: DataFrame, priority: str, least, *ties: str) -> DataFrame:
    """What a priority queue gives while its top has a priority of `least` or more: largest first, then by ties."""
    return queue.where(F.col(priority) >= least).orderBy(F.desc(priority), *ties)


def first_nodes(nodes: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of (id, seq, ...) in order; of rows of one id the newest seq stays, the earlier one of equal ones."""
    read = nodes.orderBy(*order).limit(n)
    place = F.struct(F.col("seq"), *[-F.col(c) if dict(nodes.dtypes)[c] != "string" else F.col(c) for c in order])
    rest = [c for c in nodes.columns if c != "id"]
    return read.groupBy("id").agg(F.max_by(F.struct(*rest), place).alias("_r")).select("id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def node_filter(nodes: DataFrame, network: str | None = None, min_age: float | None = None, forks: tuple[str, ...] = (), snap: bool = False, light: bool = False) -> DataFrame:
    """Nodes that pass every test given: address in a CIDR network, seconds between first and last answer, fork id in a set, capabilities.

    nodes: ip, first_response, last_response, record (map of entry name to value; `eth` holds the fork id).
    """
    tests = [in_network(F.col("ip"), network)] if network else []
    if min_age is not None:
        tests.append(F.unix_micros(F.col("last_response").cast("timestamp")) - F.unix_micros(F.col("first_response").cast("timestamp")) >= int(min_age * 1_000_000))
    if forks:
        tests.append(F.coalesce(F.try_element_at("record", F.lit("eth")).isin(*forks), F.lit(False)))
    tests += [F.map_contains_key("record", name) for name, wanted in (("snap", snap), ("les", light)) if wanted]
    return nodes.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def fair_mix(rows: DataFrame, source: str, *order: str) -> DataFrame:
    """rows with `turn`: sources take turns, each giving its next row by order; sort by (turn, source) to read them mixed."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(*order)).cast("long"))


def prestate(steps: DataFrame, diff: bool = False) -> DataFrame:
    """What a transaction found in each slot it touched; with diff, slots it changed, before and after.

    steps: tx, seq, address, slot, before, after (equal for a read).
    """
    per = steps.groupBy("tx", "address", "slot").agg(F.min_by("before", "seq").alias("pre"), F.max_by("after", "seq").alias("post"))
    return per.where(~F.col("pre").eqNullSafe(F.col("post"))) if diff else per.drop("post")
