"""Base fee and blob fee of the next block, and fee history."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators.chain import weighted_percentiles

# Fixed values of the public fee rules: target = limit / ELASTICITY, a step is at most 1 / CHANGE;
# blob gas of a blob, target and most of a block, least fee and divisor of the exponent.
ELASTICITY, CHANGE = 2, 8
BLOB_GAS, BLOB_TARGET, BLOB_MOST, BLOB_LEAST, BLOB_DIVISOR = 131072, 393216, 786432, 1, 3338477


def next_base_fee(base_fee: Column, gas_used: Column, gas_limit: Column) -> Column:
    """The base fee of the block after one: up or down by base * (used - target) / target / 8, up by 1 at least."""
    div = lambda a, b: F.call_function("div", a, b)
    target = div(gas_limit.cast("decimal(38,0)"), F.lit(ELASTICITY).cast("decimal(38,0)"))
    gap = F.abs(gas_used.cast("decimal(20,0)") - target.cast("decimal(20,0)"))
    step = div(div(base_fee.cast("decimal(18,0)") * gap.cast("decimal(20,0)"), target.cast("decimal(20,0)")).cast("decimal(20,0)"), F.lit(CHANGE).cast("decimal(38,0)"))
    return F.when(gas_used == target, base_fee).when(gas_used > target, base_fee + F.greatest(step, F.lit(1).cast("long"))).otherwise(F.greatest(base_fee - step, F.lit(0).cast("long")))


def next_excess_blob_gas(excess: Column, used: Column) -> Column:
    """Blob gas beyond the target that is carried to the next block."""
    return F.greatest(excess + used - BLOB_TARGET, F.lit(0).cast("long"))


def fake_exponential(factor: int, numerator: int, denominator: int) -> int:
    """factor * e ** (numerator / denominator) by its Taylor series in whole numbers."""
    total, term, i = 0, factor * denominator, 1
    while term > 0:
        total, term, i = total + term, term * numerator // (denominator * i), i + 1
    return total // denominator


@F.pandas_udf(T.DecimalType(38, 0))
def blob_fee(excess: pd.Series) -> pd.Series:
    """The fee of a unit of blob gas; each distinct excess is worked out once a batch. Beyond 38 digits: null."""
    known = {x: fake_exponential(BLOB_LEAST, int(x), BLOB_DIVISOR) for x in excess.dropna().unique()}
    return excess.map(lambda x: Decimal(known[x]) if pd.notna(x) and known[x] < 10**38 else None)


def fee_history(blocks: DataFrame, txs: DataFrame, percents: tuple[int, ...] = ()) -> DataFrame:
    """(block_number, base_fee, next_base_fee, gas_used_ratio, blob_fee, next_blob_fee, blob_gas_used_ratio, rewards) of each block.

    blocks: block_number, base_fee, gas_limit, gas_used, excess_blob_gas, blob_gas_used;
    txs: block_number, tx_hash, gas_used, reward. next_ values are those that the
    following block must have. rewards is an array by percents, zeros for a block
    without transactions.
    """
    out = blocks.select(
        "block_number",
        "base_fee",
        next_base_fee(F.col("base_fee"), F.col("gas_used"), F.col("gas_limit")).alias("next_base_fee"),
        (F.col("gas_used") / F.col("gas_limit")).alias("gas_used_ratio"),
        blob_fee("excess_blob_gas").alias("blob_fee"),
        blob_fee(next_excess_blob_gas(F.col("excess_blob_gas"), F.col("blob_gas_used"))).alias("next_blob_fee"),
        (F.col("blob_gas_used") / F.lit(BLOB_MOST)).alias("blob_gas_used_ratio"),
    )
    if not percents:
        return out
    points = weighted_percentiles(txs, percents).groupBy("block_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "reward"))), lambda x: x["reward"]).alias("rewards"))
    none = F.array(*[F.lit(0).cast("long") for _ in percents])
    return out.join(points, "block_number", "left").withColumn("rewards", F.coalesce("rewards", none))


def suggested_tip(txs: DataFrame, blocks: int, per_block: int, percentile: int, least: int, most: int) -> DataFrame:
    """One row `tip`: of the per_block lowest rewards (from least on) of each of the last blocks, the one at (n - 1) * percentile / 100.

    txs: block_number, tx_hash, reward, and, if the table has them, sender and miner:
    a miner's own transactions don't count. Each visited block that gives one value
    alone makes the look-back one block longer, up to twice `blocks`. Null if there is no value.
    """
    head = txs.agg(F.max("block_number")).first()[0] or 0
    near = txs.where(F.col("block_number") > head - 2 * blocks)  # at most twice `blocks` blocks
    if {"sender", "miner"} <= set(txs.columns):
        near = near.where(~F.col("sender").eqNullSafe(F.col("miner")))
    low = near.where(F.col("reward") >= least).withColumn("_r", F.row_number().over(Window.partitionBy("block_number").orderBy("reward", "tx_hash"))).where(F.col("_r") <= per_block)
    per = low.groupBy("block_number").agg(F.collect_list("reward").alias("values"))
    every = txs.sparkSession.range(max(0, head - 2 * blocks + 1), head + 1).withColumnRenamed("id", "block_number")
    back = Window.orderBy(F.desc("block_number")).rowsBetween(Window.unboundedPreceding, -1)  # over 2 * blocks rows
    several = F.coalesce(F.size("values") != 1, F.lit(True)).cast("int")  # all but blocks of one value
    # a block is visited while fewer than `blocks` of those above it count in full
    visited = every.join(per, "block_number", "left").withColumn("_full", F.coalesce(F.sum(several).over(back), F.lit(0))).where(F.col("_full") < blocks)
    found = visited.agg(F.sort_array(F.flatten(F.collect_list("values"))).alias("v"))
    tip = F.get("v", F.floor((F.size("v") - 1) * percentile / 100).cast("int"))
    return found.select(F.when(F.size("v") > 0, F.least(tip, F.lit(most).cast("long"))).alias("tip"))
