"""Text traces against a line-by-line simulation."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.functions.categories import OP_RULES, STORAGE_RULES, category, pretty_size, storage_prefix
from marlstone.operators import access, chain
from marlstone.sources import grammar, reports

STAMP = "node: 2025/02/11 19:18:38 trace.src:29: "


def random_trace(seed, n=400):
    r, lines, block = random.Random(seed), [], 100
    for _ in range(n):
        key = r.choice(["41", "4f", "6f", "c", "ff", "6342"]) + f"{r.randrange(12):03x}"
        lines.append(r.choice([
            f"OPType: Get, key: {key}, size: {len(key) // 2}", f"OPType: Put, key: {key}, size: 2, value: c0ff, size: 2", f"OPType: BatchPut, key: {key}, size: 2, value: , size: 0",
            f"OPType: BatchDelete, key: {key}, size: 2", "OPType: NewBatch", "OPType: NewBatchWithSize, size: 4", "OPType: NewIterator, prefix: 6f, start key: ", "OPType: NewIterator, prefix: , start key: 01",
            "OPType: Get, key: , size: 0", "OPType: Compact, start key: 01, end key: 02", "Closing database",
        ]))
        if r.random() < 0.05:
            lines.append(f"Processing block (end), ID: {block}, hash: 0xab")
        if r.random() < 0.08:
            block += r.choice([0, 1, 1, 7])
            lines.append(f"Processing block (start), ID: {block}, hash: 0xab")
    return [STAMP + x for x in lines]


def simulate(lines):
    """(counts by (category, op), segments of Get keys with their block)."""
    counts, segments, block = Counter(), [(None, [])], None
    for line in lines:
        if m := re.search(r"Processing block \(start\), ID: (\d+)", line):
            block = int(m[1])
            segments.append((block, []))
        elif m := re.search(r"OPType: (\w+),(?: key: ([0-9a-fA-F]*), size)?(?: prefix: ([0-9a-fA-F]*),)?", line):
            key = m[2] or m[3] or ""
            name = next((c for p, c in OP_RULES if key.startswith(p)), "Unknown") if key else "noPrefix"
            counts[name, m[1]] += 1
            if m[1] == "Get" and key:
                segments[-1][1].append(key)
    return counts, segments


@pytest.mark.parametrize("seed", [1, 2])
def test_parse_order_and_segments(spark, tmp_path, seed):
    lines = random_trace(seed)
    (tmp_path / "t").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        parsed = grammar.segments(grammar.parse(grammar.read_trace(spark, str(tmp_path / "t"))))
        rows = parsed.orderBy("file", "split_start", "mid").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.line for r in rows] == lines and len({r.split_start for r in rows}) > 3
    counts, segments = simulate(lines)
    ops = spark.createDataFrame([(r.op_type, r.key) for r in rows if r.op_type], "op_type string, key string").withColumn("category", category(F.col("key")))
    assert {(r.category, r.op_type): r.n for r in access.op_counts(ops).collect()} == counts
    reads = spark.createDataFrame([(r.segment_id, i, r.block_id, r.key) for i, r in enumerate(rows) if r.op_type == "Get" and r.key], "segment_id long, seq long, block_id long, key string")
    for d in (0, 1, 4):
        want = defaultdict(list)
        for block, keys in segments:
            for x, y in zip(keys, keys[d + 1 :], strict=False):
                want[tuple(sorted((x, y)))].append(block)
        got = {(r.k1, r.k2): (r.freq, r.blocks) for r in access.pair_counts(access.neighbours(reads, (d,)), []).collect()}
        assert got == {k: (len(v), sorted({b for b in v if b is not None})) for k, v in want.items() if len(v) > 1}


def test_updates_against_loop(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["Put", "BatchPut", "Get", "BatchDelete"]), f"k{r.randrange(40)}") for i in range(300)]
    held, seen, want = {f"k{i}" for i in range(5)}, set(), {}
    for i, op, key in rows:
        write = op in ("Put", "BatchPut")
        want[i] = "Update" if write and (key in held or key in seen) else op
        seen |= {key} if write else set()
    got = access.classify_updates(spark.createDataFrame(rows, "seq long, op_type string, key string"), spark.createDataFrame([(k,) for k in held], "key string"))
    assert {x.seq: x.new_op for x in got.collect()} == want


def test_rules(spark):
    rows = spark.createDataFrame([("636874526f6f7456322d01",), ("63",), ("694201",), ("6901",), ("ff",), ("",), (None,)], "k string")
    got = rows.select(category(F.col("k")), storage_prefix(F.col("k"))).collect()
    assert [r[0] for r in got] == ["ChtPrefix", "CodePrefix", "BloomBitsIndexPrefix", "BloomBitsIndexPrefix", "Unknown", "noPrefix", "noPrefix"]
    assert [r[1] for r in got][:4] == ["63", "63", "6942", "noPrefix"] and len(STORAGE_RULES) == 52
    sizes = spark.createDataFrame([(1024,), (1025,), (1048577,)], "n long").select(pretty_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["1024.00 B", "1.00 KiB", "1.00 MiB"]


def test_batches(spark):
    got = spark.range(0, 101).select(access.batch_of(F.col("id"), 0, 50)).collect()
    assert Counter(r[0] for r in got) == {0: 51, 1: 50}


def test_reports_round_trip(spark, tmp_path):
    counts = spark.createDataFrame([("a", "Get", 3), ("a", "Put", 1), ("b", "Get", 9)], "category string, op_type string, n long")
    reports.write_counts(counts, f"{tmp_path}/c")
    assert sorted(map(tuple, reports.read_counts(spark, f"{tmp_path}/c").collect())) == sorted(map(tuple, counts.collect()))
    ranked = access.ranked(spark.createDataFrame([("x", "get", "k1", 2), ("x", "get", "k2", 5)], "category string, bucket string, key string, n long"), ["category", "bucket"])
    reports.write_distribution(ranked, f"{tmp_path}/d")
    assert sorted(map(tuple, reports.read_distribution(spark, f"{tmp_path}/d/category=x/bucket=get").collect())) == [(1, "k2", 5), (2, "k1", 2)]
    pairs = spark.createDataFrame([("41ab-2", "4f-1", 7, "1;2")], "k1 string, k2 string, freq long, blocks string")
    reports.write_pairs(pairs, f"{tmp_path}/p")
    assert reports.read_pairs(spark, f"{tmp_path}/p").collect() == pairs.collect()
    (tmp_path / "bad").write_text("nonsense\n")
    with pytest.raises(Exception, match="not a pair"):
        reports.read_pairs(spark, f"{tmp_path}/bad").collect()
    (tmp_path / "list").write_text("b\na\nb\n")
    assert reports.listed_files(spark, f"{tmp_path}/list") == ["a", "b"]
    (tmp_path / "nodes").write_text('{"n1": {"seq": "1", "ip": "10.0.0.1"}}')
    assert reports.read_nodes(spark, f"{tmp_path}/nodes").first().record["ip"] == "10.0.0.1"


def test_min_after_zero(spark):
    r = random.Random(9)
    for _ in range(3):
        sizes = [r.choice([0, 1, 2, 3, 5]) for _ in range(12)]
        low = 0
        for s in sizes:
            low = s if low == 0 or s < low else low
        kv = spark.createDataFrame([("g", f"{i:03d}", "x" * s) for i, s in enumerate(sizes)], "g string, key string, value string")
        assert access.min_after_zero(kv, "g").first().min_value == low


def test_log_criteria(spark):
    logs = spark.createDataFrame([(0, "A1", []), (1, "A1", ["T1"]), (1, "A2", ["T1"]), (2, "A3", ["T2"]), (3, "A3", ["T2"])], "block_number long, address string, topics array<string>")
    n = lambda **k: chain.log_filter(logs, **k).count()
    assert (n(), n(addresses=["A1"]), n(topics=[["T1"]]), n(topics=[[]]), n(topics=[[], []]), n(first=1, last=2), n(addresses=["A3"], topics=[["T2", "T1"]], first=3)) == (5, 2, 2, 4, 0, 3, 1)
    for bad in (dict(first=5, last=2), dict(block_hash="x", first=1), dict(topics=[[]] * 5), dict(topics=[["t"] * 1001])):
        with pytest.raises(ValueError):
            chain.check_criteria(**bad)


def test_layers_and_pages(spark):
    rows = [("a", 1, 5.0, False), ("a", 2, None, True), ("b", 1, 1.0, False), ("c", 1, None, True), ("c", 3, 9.0, False)]
    got = chain.newest(spark.createDataFrame(rows, "key string, layer long, value double, gone boolean"), ["key"], "layer", F.col("gone"))
    assert sorted((r.key, r.value) for r in got.collect()) == [("b", 1.0), ("c", 9.0)]
    keys = spark.createDataFrame([(k,) for k in ("ka1", "ka2", "ka3", "ka4", "ka5", "kb1")], "k string")
    assert [r.k for r in chain.prefix_scan(keys, "k", "ka", "3").orderBy("k").collect()] == ["ka3", "ka4", "ka5"]
    assert chain.prefix_scan(keys, "k", "ka", "8").count() == 0
    assert [(r.id, r.next_key) for r in chain.keyset_page(spark.range(5), "id", 1, 2).collect()] == [(1, 3), (2, 3)]
    assert [r.next_key for r in chain.keyset_page(spark.range(3), "id", 1, 5).collect()] == [None, None]


def test_ewma_decay(spark):
    ticks = spark.createDataFrame([("m", i, 3 if i == 0 else 0) for i in range(13)], "g string, t int, n int")
    rate = chain.ewma(ticks, "g", "t", "n", 5.0, 1.0).first().rate
    assert abs(rate - 0.22072766470286553) < 1e-9  # a minute after three events in one tick
