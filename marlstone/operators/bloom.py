"""Bloom filters of logs by block, and their bit-sliced index by section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.codecs import bloom_bits, keccak256

BITS = 2048


def bits_of(value: bytes) -> list[int]:
    h = keccak256([value])[0]
    return [int.from_bytes(h[i : i + 2], "big") & (BITS - 1) for i in (0, 2, 4)]


def set_bits(logs: DataFrame, values: list[str]) -> DataFrame:
    """(block_number, bit) of the values (binary arrays or binaries) of logs; a distinct value is hashed once for each block."""
    each = logs.select("block_number", F.explode(F.array_distinct(F.array(*values))).alias("v")).distinct()
    return each.select("block_number", F.explode(bloom_bits("v")).alias("bit")).distinct()


def filters(bits: DataFrame) -> DataFrame:
    """(block_number, bloom): 256 bytes, bit b at byte b / 8."""
    return bits.groupBy("block_number").agg(F.substring(F.bitmap_construct_agg(F.col("bit").cast("long")), 1, BITS // 8).alias("bloom"))


def index(bits: DataFrame, section: int = 4096) -> DataFrame:
    """(section, bit, blocks): a bitmap of the blocks of a section that set the bit; section is 32768 at most."""
    by = [F.floor(F.col("block_number") / section).alias("section"), "bit"]
    return bits.groupBy(*by).agg(F.bitmap_construct_agg((F.col("block_number") % section).cast("long")).alias("blocks"))


def candidates(idx: DataFrame, clauses: list[list[bytes]], section: int = 4096) -> DataFrame:
    """Blocks that may hold, for each clause, one of its values; empty clauses match anything. A superset, never less."""
    asked = [(c, i, b, len(set(bits_of(v)))) for c, values in enumerate(x for x in clauses if x) for i, v in enumerate(values) for b in set(bits_of(v))]
    n = len({c for c, *_ in asked})
    if not n:
        raise ValueError("no clause limits the blocks")
    want = idx.sparkSession.createDataFrame(asked, "clause int, alt int, bit int, need int")  # bounded by the criteria
    hit = idx.join(F.broadcast(want), "bit").groupBy("section", "clause", "alt", "need").agg(F.bitmap_and_agg("blocks").alias("blocks"), F.count("*").alias("k")).where("k = need")
    hit = hit.groupBy("section", "clause").agg(F.bitmap_or_agg("blocks").alias("blocks"))
    hit = hit.groupBy("section").agg(F.bitmap_and_agg("blocks").alias("blocks"), F.count("*").alias("k")).where(F.col("k") == n)
    byte = F.conv(F.expr("hex(substring(blocks, p div 8 + 1, 1))"), 16, 10).cast("int")
    spread = hit.select("section", "blocks", F.explode(F.sequence(F.lit(0), F.lit(section - 1))).alias("p"))
    return spread.where(byte.bitwiseAND(F.expr("shiftleft(1, p % 8)")) != 0).select((F.col("section") * section + F.col("p")).alias("block_number"))
