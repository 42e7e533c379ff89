"""Block batches, tags, fees, inspection, queues and tracers on small fixtures."""

import json
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from marlstone.functions import categories
from marlstone.operators import access, batches, fees, inspection, pool, queues


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=str)


def test_batches_need_both_ends_and_drop_the_rest(spark):
    df = spark.createDataFrame([(x,) for x in [*range(5, 21), 25, 30]], "block_id long")
    table = batches.batch_table(spark, ((5, 9), (10, 14), (19, 22), (25, 25), (28, 30)))
    assert rows(batches.in_batches(df, table), "batch", "block_id") == sorted([*[(0, x) for x in range(5, 10)], *[(1, x) for x in range(10, 15)], (3, 25)], key=str)
    assert rows(batches.in_batches(df, table, whole=False), "batch", "block_id")[-1] == (4, 30)
    assert len(batches.BATCHES) == 8 and all(a[1] + 1 == b[0] for a, b in pairwise(batches.BATCHES))
    with pytest.raises(ValueError):
        batches.batch_table(spark, ((1, 5), (5, 6)))
    assert batches.in_batches(df.limit(0), table).count() == 0


def test_start_block_is_exact(spark):
    df = spark.createDataFrame([(None,), (19,), (20,), (200,)], "block_id long")
    assert rows(batches.from_block(df, 20)) == [(20,), (200,)]


def test_tags(spark):
    logs = spark.createDataFrame([(i,) for i in range(101)], "block_number long")
    head = batches.heads(logs, 32, 64).first().asDict()
    assert head == {"latest": 100, "safe": 68, "finalized": 36}
    for tag, want in (("latest", 100), ("pending", 100), ("safe", 68), ("finalized", 36), ("earliest", 0), (7, 7), (-2, 100), (-3, 36), (-4, 68)):
        assert batches.resolve(tag, head) == want
    assert batches.log_range(logs, head, "safe", "latest").count() == 33
    for bad in ("pending", -1):
        with pytest.raises(ValueError):
            batches.log_range(logs, head, bad, "latest")
    with pytest.raises(ValueError):
        batches.resolve("finalized", {"latest": 3})
    with pytest.raises(ValueError):
        batches.resolve(-9, head)


def test_store_range(spark):
    items = spark.createDataFrame([("h", i, b"x" * 10) for i in range(20)] + [("b", i, b"y") for i in (3, 4, 6)], "kind string, number long, data binary")
    pick = lambda *a: [r[0] for r in rows(batches.store_range(items, *a), "number")]
    assert pick("h", 2, 3) == [2, 3, 4]
    assert pick("h", 2, 9, 25) == [2, 3]
    assert pick("h", 2, 9, 1) == [2]  # at least one
    assert pick("b", 3, 9) == [3, 4] and pick("b", 5, 9) == []  # unbroken from the start


@pytest.mark.parametrize(("used", "want"), [(10_000_000, 1_000_000_000), (9_000_000, 987_500_000), (11_000_000, 1_012_500_000)])
def test_base_fee(spark, used, want):
    df = spark.createDataFrame([(1_000_000_000, used, 20_000_000), (1, 10_000_001, 20_000_000), (0, 0, 20_000_000), (9 * 10**17, 20_000_000, 20_000_000)], "b long, u long, l long")
    got = [r[0] for r in df.select(fees.next_base_fee(F.col("b"), F.col("u"), F.col("l")).cast("long")).collect()]
    assert got == [want, 2, 0, 9 * 10**17 + 9 * 10**17 // 8]


def test_blob_fee(spark):
    for case in ((1, 0, 1, 1), (38493, 0, 1000, 38493), (0, 1234, 2345, 0), (1, 2, 1, 6), (1, 6, 2, 18), (10, 8, 2, 542), (1, 5, 2, 11), (2, 5, 2, 23), (1, 50000000, 2225652, 5709098764)):
        assert fees.fake_exponential(*case[:3]) == case[3]
    df = spark.createDataFrame([(0,), (2314057,), (2314058,), (10 * 1024 * 1024,), (None,), (400_000_000,)], "e long")
    got = [r[0] for r in df.select(fees.blob_fee("e")).collect()]
    assert [None if x is None else int(x) for x in got] == [1, 1, 2, 23, None, None]
    blob = fees.BLOB_GAS
    df = spark.createDataFrame([(0, 0, 0), (0, 3 * blob, 0), (0, 4 * blob, blob), (blob, 3 * blob, blob), (blob, 2 * blob, 0), (2 * blob, blob, 0)], "e long, u long, want long")
    assert df.where(fees.next_excess_blob_gas(F.col("e"), F.col("u")) != F.col("want")).count() == 0


def test_tip_looks_back_further_over_blocks_of_one_value(spark):
    tx = [(b, b * 10 + i, 100 + b + i, b * 10 + i, -1) for b in range(1, 11) for i in range(1 if b > 6 else 3)]
    cols = "block_number long, tx_hash long, reward long, sender long, miner long"
    tip = lambda t, n: fees.suggested_tip(spark.createDataFrame(t, cols), n, 3, 0, 2, 10_000).first().tip
    # blocks 10, 9, 8, 7 have one value each, so three blocks become six: 10 to 5
    assert tip(tx, 3) == 105
    assert tip([t if t[0] != 5 else (*t[:4], t[3]) for t in tx], 3) == 106  # a miner's own don't count
    assert tip([(1, 1, 50, 1, 0)], 3) == 50 and tip([(1, 1, 1, 1, 0)], 3) is None


def test_inspection_of_each_class(spark):
    h, p = "ab" * 32, inspection.PREFIX
    keys = {
        "Headers": ["68" + "00" * 8 + h], "Bodies": ["62" + "00" * 8 + h], "Receipt lists": ["72" + "01" * 8 + h], "Difficulties": ["68" + "00" * 8 + h + "74"], "Block number->hash": ["68" + "00" * 8 + "6e"],
        "Block hash->number": ["48" + h], "Transaction index": ["6c" + h], "Contract codes": ["63" + h], "Path trie state lookups": ["4c" + h],
        "Path trie account nodes": ["41", "4101", "41" + "0f" * 63], "Path trie storage nodes": ["4f" + h, "4f" + h + "00" * 63], "Account snapshot": ["61" + h], "Storage snapshot": ["6f" + h + h],
        "Trie preimages": [p["PreimagePrefix"] + h], "Bloombit index": ["42" + "00" * 10 + h, "6942", "6942ff"], "Beacon sync headers": ["53" + "00" * 8], "Clique snapshots": [p["CliqueSnapshotPrefix"] + h],
        "CHT trie nodes": [p["ChtPrefix"], p["ChtTablePrefix"] + "00"], "Bloom trie nodes": [p["BloomTriePrefix"], p["BloomTrieIndexPrefix"] + "0102"],
        "Verkle trie nodes": ["7641", "764101"], "Verkle trie state lookups": ["764c" + h],
        "Singleton metadata": [p["HeadBlockKey"], p["ConfigPrefix"] + h, p["GenesisPrefix"] + h, "76" + p["TrieJournalKey"], p["UncleanShutdownKey"]],
        "unaccounted": ["41" + "00" * 64, "4f" + "00" * 31, "63" + h + "00", "7699", "68", "", p["HeadBlockKey"] + "00", "ff" * 32],
    }
    table = [(bytes.fromhex(k), b"v" * 3) for ks in keys.values() for k in ks]
    from marlstone.functions.codecs import keccak256

    table.append((keccak256([b"node"])[0], b"node"))
    ancients = spark.createDataFrame([("headers", 5, 50)], "kind string, n long, bytes long")
    got = {r.kind: (r.n, r.bytes) for r in inspection.inspect(spark.createDataFrame(table, "key binary, value binary"), ancients).collect()}
    for kind, ks in keys.items():
        assert got[kind] == (len(ks), sum(len(k) // 2 + 3 for k in ks)), kind
    assert got["Hash trie nodes"] == (1, 36) and got["headers"] == (5, 50)
    assert got["Total"] == (len(table) + 5, sum(len(k) + len(v) for k, v in table) + 50) and len(got) == 23 + 3
    assert set(categories.STORAGE_RULES) <= set(inspection.PREFIX.values())


def test_queues(spark):
    p = spark.createDataFrame([(a, n) for a in (1, 2) for n in (5, 3, 9, 4)] + [(3, 1)], "account long, nonce long")
    kept, gone = queues.forward(p, spark.createDataFrame([(1, 5), (3, 0)], "account long, least long"))
    assert rows(gone) == [(1, 3), (1, 4)] and kept.count() == 7
    kept, gone = queues.cap(p, 3)
    assert rows(gone) == [(1, 9), (2, 9)] and kept.count() == 7
    content = {r.account: r.t for r in queues.pool_content(p, F.concat(F.lit("n"), F.col("nonce").cast("string"))).select("account", F.to_json("content").alias("t")).collect()}
    assert content[1] == '{"3":"n3","4":"n4","5":"n5","9":"n9"}' and content[3] == '{"1":"n1"}'
    q = spark.createDataFrame([("a", 1), ("b", 7), ("c", 7), ("d", 9)], "k string, p int")
    assert [r.k for r in queues.pop_until(q, "p", 7, "k").collect()] == ["d", "b", "c"]
    nodes = spark.createDataFrame([(i, "xyzxyx"[i], [1, 5, 1, 4, 4, 9][i]) for i in range(6)], "place int, id string, seq int")
    assert rows(queues.first_nodes(nodes, 5, "place"), "id", "place", "seq") == [("x", 3, 4), ("y", 1, 5), ("z", 2, 1)]  # the sixth isn't read; of y's the newest seq stays
    mixed = queues.fair_mix(spark.createDataFrame([("a", i) for i in range(3)] + [("b", 10)], "s string, n int"), "s", "n")
    assert [r.n for r in mixed.orderBy("turn", "s").collect()] == [0, 10, 1, 2]


def test_node_filters(spark):
    from datetime import datetime

    t = lambda m: datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([("a", "10.0.0.1", t(0), t(30), {"eth": "f1", "snap": ""}), ("b", "10.0.1.1", t(0), t(5), {"eth": "f2", "les": ""}), ("c", "11.0.0.1", t(0), t(59), {})], "id string, ip string, first_response timestamp, last_response timestamp, record map<string,string>")
    pick = lambda **k: [r.id for r in queues.node_filter(df, **k).orderBy("id").collect()]
    assert pick() == ["a", "b", "c"] and pick(network="10.0.0.0/16") == ["a", "b"] and pick(min_age=1800) == ["a", "c"]
    assert pick(forks=("f1", "f3")) == ["a"] and pick(snap=True) == ["a"] and pick(light=True) == ["b"] and pick(network="10.0.0.0/8", min_age=60, snap=True) == ["a"]


def test_call_trees_and_parents(spark):
    depths = [0, 1, 2, 2, 1, 3, 0, 1]
    df = spark.createDataFrame([(7, i, d, "x") for i, d in enumerate(depths)] + [(8, 0, 0, "y")], "tx long, seq long, depth int, parent_ string").repartition(3)
    got = {(r.tx, r.seq): r.parent for r in pool.call_parents(df).collect()}
    want = {(7, i): max((j for j in range(i) if depths[j] == d - 1), default=None) for i, d in enumerate(depths)} | {(8, 0): None}
    assert got == want and set(pool.call_parents(df).columns) == {"tx", "seq", "depth", "parent_", "parent"}
    tree = {r.tx: json.loads(r.tree) for r in pool.run_tracer("call_tree", df).collect()}
    assert [n["seq"] for n in tree[7]] == [0, 6] and [n["seq"] for n in tree[7][0]["calls"]] == [1, 4] and [n["seq"] for n in tree[7][0]["calls"][0]["calls"]] == [2, 3]


def test_several_tracers_give_what_each_gives(spark):
    df = spark.createDataFrame([(t, i, (i * t) % 3, f"op{i % 2}") for t in (1, 2) for i in range(5)], "tx long, seq long, depth int, op string")
    got = {(r.tx, r.tracer): json.loads(r.result) for r in pool.run_tracers(["depths", "call_tree", "opcodes"], df).collect()}
    assert got[1, "depths"] == {"deepest": 2, "steps": 5} and got[2, "opcodes"] == {"kinds": 2, "steps": 5}
    alone = {r.tx: r.tree for r in pool.run_tracer("call_tree", df).collect()}
    assert {t: got[t, "call_tree"][0]["tree"] for t in (1, 2)} == alone


def test_prestate(spark):
    df = spark.createDataFrame([(1, 0, "a", "s", 5, 5), (1, 1, "a", "s", 5, 6), (1, 2, "a", "s", 6, 7), (1, 3, "b", "s", 1, 1), (2, 0, "a", "s", 7, 8), (2, 1, "a", "s", 8, 7)], "tx long, seq long, address string, slot string, before long, after long")
    assert rows(queues.prestate(df)) == [(1, "a", "s", 5), (1, "b", "s", 1), (2, "a", "s", 7)]
    assert rows(queues.prestate(df, True)) == [(1, "a", "s", 5, 7)]  # put back: no change


def test_ranked_wide_leaves_small_groups_out(spark):
    df = spark.createDataFrame([("a", f"k{i}", i % 4) for i in range(30)] + [("b", "only", 3)], "g string, key string, n long").repartition(4)
    got = rows(access.ranked_wide(df, ["g"], 2), "g", "id", "key", "n")
    assert got == rows(access.ranked(df, ["g"], 2), "g", "id", "key", "n") and len(got) == 30
    assert rows(access.ranked_wide(df, ["g"]), "g", "id", "key", "n") == rows(access.ranked(df, ["g"]), "g", "id", "key", "n")


def test_samples_are_uniform_and_favour_the_new(spark):
    from marlstone.operators import chain

    df = spark.range(2000).withColumn("t", F.col("id").cast("double"))
    hits = [chain.uniform_sample(df, 100, seed, "id").agg(F.avg("id")).first()[0] for seed in range(12)]
    assert 900 < sum(hits) / 12 < 1100  # the mean of all is 999.5, of 12 samples within 17 of it
    one = rows(chain.uniform_sample(df, 100, 3, "id"), "id")
    assert len(one) == len(set(one)) == 100 and one == rows(chain.uniform_sample(df.repartition(7), 100, 3, "id"), "id")
    late = [chain.decaying_sample(df, 100, seed, F.col("t"), 0.01, "id").agg(F.avg("id")).first()[0] for seed in range(6)]
    assert min(late) > 1700  # weights grow by e every 100 rows
    flat = chain.decaying_sample(df, 100, 1, F.col("t"), 0.0, "id").agg(F.avg("id")).first()[0]
    assert 800 < flat < 1200


def test_end_markers_that_do_not_match(spark):
    from marlstone.sources import grammar

    lines = ["Processing block (start), ID: 5, hash: 0x1", "OPType: Get, key: 41, size: 1", "Processing block (end), ID: 5, hash: 0x1", "Processing block (start), ID: 6, hash: 0x2", "Processing block (end), ID: 7, hash: 0x2"]
    for some, want in ((lines, [7]), (lines[:3], []), (lines[2:3], [5]), ([], [])):
        df = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(some)], "file string, split_start long, mid long, line string")
        assert [r.end_id for r in grammar.mismatched_ends(grammar.segments(grammar.parse(df))).collect()] == want
