"""The driver tables in the shapes that the operators take, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.categories import category

OPS = {"view": "Get", "click": "BatchPut", "purchase": "Put", "error": "BatchDelete", "signup": "NewIterator"}
PREFIXES = ("41", "4f", "61", "6f", "63", "6c")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_trace(events: DataFrame) -> DataFrame:
    op = F.element_at(F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair]), F.col("event_type"))
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("user_id") % 6 + 1).cast("int"))
    digits = F.lower(F.hex("user_id"))
    key = F.concat(prefix, F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))  # lpad cuts what is longer
    rows = events.select(F.col("event_id").alias("seq"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long").alias("block_id"), op.alias("op_type"), key.alias("key"), "ts", "user_id", "value")
    return rows.withColumn("category", category(F.col("key"))).withColumn("segment_id", F.col("block_id"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_trace(table(spark, sf_dir, "events"))


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("lang", F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("value"), "doc_id")


#: Order keys of a block.
BLOCK_KEYS = 100


def logs(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Log rows, of blocks first to last if given: the range is put on the stored column, so that the scan can use it."""
    x = table(spark, sf_dir, "lineitem")
    x = x if first is None else x.where(F.col("l_orderkey") >= first * BLOCK_KEYS)
    x = x if last is None else x.where(F.col("l_orderkey") < (last + 1) * BLOCK_KEYS)
    block = F.floor(F.col("l_orderkey") / BLOCK_KEYS)
    return x.select(block.alias("block_number"), F.col("l_orderkey").alias("tx_hash"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("address"), F.array("l_returnflag", "l_linestatus").alias("topics"), F.col("l_partkey").alias("data"), F.col("l_quantity").cast("long").alias("gas_used"), F.col("l_extendedprice").alias("price"))


def txs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    price = F.floor("o_totalprice")
    return o.select(F.floor(F.col("o_orderkey") / 100).alias("block_number"), F.col("o_orderkey").alias("tx_hash"), F.col("o_custkey").alias("sender"), F.col("o_orderstatus").alias("status"), (price % 1000 + 1).alias("gas_used"), price.alias("reward"))


TRACE = """trace AS (
  SELECT event_id AS seq, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS block_id,
         CASE event_type WHEN 'view' THEN 'Get' WHEN 'click' THEN 'BatchPut' WHEN 'purchase' THEN 'Put' WHEN 'error' THEN 'BatchDelete' ELSE 'NewIterator' END AS op_type,
         (['41','4f','61','6f','63','6c'])[user_id % 6 + 1] || format('{:04x}', user_id) AS key,
         (['TrieNodeAccountPrefix','TrieNodeStoragePrefix','SnapshotAccountPrefix','SnapshotStoragePrefix','CodePrefix','TxLookupPrefix'])[user_id % 6 + 1] AS category,
         CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'batchput' WHEN 'purchase' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'scan' END AS bucket,
         user_id, value, ts, CAST(greatest(0, ceil(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5.0) - 1) AS BIGINT) AS batch
  FROM events)"""
KV = "kv AS (SELECT lang, source || ':' || doc_id AS key, text AS value, doc_id FROM documents)"
LOGS = "logs AS (SELECT l_orderkey // 100 AS block_number, l_orderkey AS tx_hash, l_linenumber AS pos, l_suppkey AS address, l_returnflag AS t0, l_linestatus AS t1, l_partkey AS data, CAST(l_quantity AS BIGINT) AS gas_used, l_extendedprice AS price FROM lineitem)"
TXS = "txs AS (SELECT o_orderkey // 100 AS block_number, o_orderkey AS tx_hash, o_custkey AS sender, o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) % 1000 + 1 AS gas_used, CAST(floor(o_totalprice) AS BIGINT) AS reward FROM orders)"


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
