"""Operators over all rows of a table, where a query's SQL asks for less or the given tables don't reach."""

import duckdb
from pyspark.sql import functions as F

from marlstone.plans import adapters as ad
from marlstone.plans import catalog

MIDDLE = "/root/testdata/sf0.01"


def test_bloom_index_covers_all_blocks(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{MIDDLE}/lineitem.parquet'")
    blocks = con.execute(f"WITH {ad.LOGS} SELECT DISTINCT block_number FROM logs").fetchall()
    assert max(blocks)[0] > 40
    assert {tuple(r) for r in catalog.log_blooms(spark, MIDDLE).select("block_number").distinct().collect()} == set(blocks)
    want = con.execute(f"WITH {ad.LOGS} SELECT {', '.join(catalog.LOG_COLUMNS)} FROM logs WHERE address IN (3, 4) AND t0 = 'R'").fetchall()
    assert max(want)[0] > 40
    assert sorted(map(tuple, catalog.log_bloom_matches(spark, MIDDLE).collect())) == sorted(want)


def test_trace_keys_of_large_users(spark, tmp_path):
    users = [None, 0, 4096, 15, 4095, 65535, 65536, 65541, 1048576, 65536, 2**40 + 4, 4096]
    kinds = ["view", "click", "purchase", "error", "signup"]
    rows = [(i, u, kinds[i % 2 + 1] if i < 10 else kinds[i % 5], f"2024-01-{i % 3 + 1:02d} 00:00:{i % 60:02d}", float(i)) for i, u in enumerate(users * 5)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.where("user_id IS NOT NULL").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert ad.as_trace(events).where("user_id IS NULL AND key IS NOT NULL").count() == 0
    for name in ("key_distribution_ranked", "distribution_merge", "distribution_ranked_wide", "update_classification", "update_counts", "rewritten_trace", "read_pairs_d0", "update_pairs_d0", "op_count_by_category"):
        out = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({catalog.SQL[name]})").fetchall()
        assert sorted(map(tuple, out.collect())) == sorted(want), name
