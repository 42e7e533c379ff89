"""Report files and archives: written, read and compared."""

import struct

import pytest
from pyspark.sql import functions as F

from marlstone.functions import codecs
from marlstone.functions.codecs import keccak256, rlp_encode
from marlstone.sources import dumps, reports


def test_category_pair_files_and_totals(spark, tmp_path):
    pairs = spark.createDataFrame([("A", "B", "41aa-1", "42bb-2", 3, "1;2"), ("A", "B", "41ac-1", "42bb-2", 9, "1"), ("A", "A", "41aa-1", "41ab-1", 5, "7")], "cat1 string, cat2 string, k1 string, k2 string, freq long, blocks string")
    reports.write_category_pairs(pairs, f"{tmp_path}/r")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/r/pairs/cat1=A/cat2=B").collect()]
    assert lines == ["key: 41ac-1;42bb-2; Freq: 9; Blocks: 1", "key: 41aa-1;42bb-2; Freq: 3; Blocks: 1;2"]
    assert reports.read_pairs(spark, f"{tmp_path}/r/pairs/cat1=A/cat2=A").count() == 1
    assert [r.value for r in spark.read.text(f"{tmp_path}/r/totals").collect()] == ["A;B: 12", "A;A: 5", "Total frequency: 17"]
    found, total = reports.read_category_totals(spark, f"{tmp_path}/r/totals")
    assert total == 17 and sorted(map(tuple, found.collect())) == [("A", "A", 5), ("A", "B", 12)]
    sizes = reports.file_sizes(spark, f"{tmp_path}/r")
    assert sizes.where("bytes > 0").count() >= 3 and set(sizes.columns) == {"path", "bytes", "gib"}
    with pytest.raises(ValueError):
        reports.read_category_totals(spark, f"{tmp_path}/r/pairs")


def test_size_report(spark, tmp_path):
    kv = spark.createDataFrame([("x", b"kk", b"v" * n) for n in (1, 2, 35)] + [("y", b"k", b"")], "kind string, key binary, value binary")
    reports.write_size_report(kv, "kind", f"{tmp_path}/s", 16)
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/s/summary").collect())
    assert "DataType: x\n  KV pair number: 3\n  Average KV size: 14.67\n  Min size for keys: 2\n  Max size for keys: 2\n  Key size distribution (Bucket width: 16 B):" in text
    assert "  Max size for values: 35" in text and "  KV pair size distribution" in text
    hist = spark.read.csv(f"{tmp_path}/s/histograms/kind=x/part=value", sep="\t", header=True, inferSchema=True)
    assert sorted(map(tuple, hist.collect())) == [(0, 2), (16, 0), (32, 1)]


def test_distribution_without_keys(spark, tmp_path):
    reports.write_distribution_counts(spark.createDataFrame([("A", 1, "k", 9), ("A", 2, "l", 3)], "category string, id long, key string, n long"), f"{tmp_path}/d")
    got = spark.read.csv(f"{tmp_path}/d/category=A", sep="\t", header=True, inferSchema=True)
    assert got.columns == ["ID", "Count"] and sorted(map(tuple, got.collect())) == [(1, 9), (2, 3)]


def test_checksums_tell_repeated_rows_apart(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b")], "block_number long, x string")
    two = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (1, "a")], "block_number long, x string")
    got = []
    for i, df in enumerate((one, two, one.repartition(3))):
        dumps.export_epochs(df, f"{tmp_path}/{i}", 10)
        got.append(dumps.epoch_checksums(spark, f"{tmp_path}/{i}").first().checksum)
    assert got[0] != got[1] and got[0] == got[2] and len(got[0]) == 64 and got[0].strip("0")
    sums = dumps.epoch_checksums(spark, f"{tmp_path}/0")
    assert dumps.read_epochs(spark, f"{tmp_path}/2", sums).count() == 4
    with pytest.raises(ValueError):
        dumps.read_epochs(spark, f"{tmp_path}/1", sums)


def entry(kind, data):
    return bytes.fromhex(dumps.ENTRY[kind]) + struct.pack("<I", len(data)) + b"\0\0" + data


def block(number):
    n = lambda x: x.to_bytes((x.bit_length() + 7) // 8, "big")
    header = rlp_encode([b"p" * 32, b"u" * 32, b"m" * 20, b"s" * 32, b"t" * 32, b"r" * 32, b"\0" * 256, n(1), n(number), n(30_000_000), n(21_000 * number), n(1_700_000_000 + number), b"", b"x" * 32, b"n" * 8, n(7 * 10**9)])
    body = rlp_encode([[[n(number), b"to"], b"\x02" + rlp_encode([n(1)])], []])
    log = [b"a" * 20, [b"t" * 32], b"data"]
    receipts = rlp_encode([[b"\x01", n(21_000), b"\0" * 256, [log, log]], b"\x02" + rlp_encode([b"", n(42_000), b"\0" * 256, []])])
    return header, body, receipts, (17 * number).to_bytes(32, "little")


def test_blocks_of_an_archive(spark):
    data = entry("version", b"")
    for number in range(100, 105):
        for kind, x in zip(("header", "body", "receipts", "difficulty"), block(number), strict=True):
            data += entry(kind, x)
    data += entry("accumulator", b"a" * 32) + entry("index", struct.pack("<q", 100) + b"\0" * 40 + struct.pack("<q", 5))
    files = spark.createDataFrame([("one", data)], "path string, content binary")
    got = {r.number: r for r in dumps.read_blocks(files).collect()}
    assert sorted(got) == list(range(100, 105))
    r = got[103]
    assert bytes(r.hash) == keccak256([block(103)[0]])[0] and r.gas_used == 21_000 * 103 and r.base_fee == str(7 * 10**9) and r.difficulty == str(17 * 103)
    assert r.n_txs == 2 and r.n_uncles == 0 and bytes(r.txs[1])[:1] == b"\x02" and [tuple(x) for x in r.receipts] == [(1, 21_000, 2), (0, 42_000, 0)]
    assert sorted(x.number for x in dumps.read_blocks(files, 101, 102).collect()) == [101, 102]
    with pytest.raises(Exception, match="bad entry"):
        dumps.read_blocks(spark.createDataFrame([("bad", data[:-3])], "path string, content binary")).collect()


def test_metric_exporters(spark):
    m = spark.createDataFrame([("a/b", 100, 3, 0.5)], "name string, ts long, count long, mean double")
    text = lambda df: [r.value for r in df.collect()]
    assert text(dumps.metric_lines(m, "geo")) == ["geo,name=a/b count=3,mean=0.5 100"]
    assert text(dumps.prometheus_text(m)) == ["# TYPE a_b_count gauge\na_b_count 3\n# TYPE a_b_mean gauge\na_b_mean 0.5"]
    assert text(dumps.graphite_lines(m, "p")) == ["p.a/b.count 3 100", "p.a/b.mean 0.5 100"]
    assert text(dumps.opentsdb_lines(m, "p", "h1")) == ["put p.a/b.count 100 3 host=h1", "put p.a/b.mean 100 0.5 host=h1"]
    assert sorted(map(tuple, dumps.read_metric_lines(dumps.metric_lines(m, "geo")).select("name", "field", "v", "ts").collect())) == [("a/b", "count", 3.0, 100), ("a/b", "mean", 0.5, 100)]


def test_state_dumps(spark, tmp_path):
    a = spark.createDataFrame([("k1", b"a", "1", b"c", "s"), ("k2", None, "2", b"d", "t")], "key string, address binary, balance string, code binary, storage string")
    assert dumps.kept_accounts(a, code=False, storage=False, addresses_only=True).columns == ["key", "address", "balance"]
    dumps.dump_accounts(a, f"{tmp_path}/l", code=False, addresses_only=True)
    assert spark.read.json(f"{tmp_path}/l").columns == ["address", "balance", "key", "storage"]
    dumps.dump_whole(a.coalesce(1), "0xroot", "key", f"{tmp_path}/w", code=False)
    got = spark.read.json(f"{tmp_path}/w").first()
    assert got.root == "0xroot" and got.accounts.k2.balance == "2" and got.accounts.k1.storage == "s"


def test_nodes_keep_nested_records(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"id1": {"seq": 3, "record": {"eth": [1, {"x": 2}]}, "score": 7, "firstResponse": "2024-01-01T00:00:00Z", "lastResponse": "2024-01-02T00:00:00Z"}, "id2": {"seq": 1, "record": "enr:-abc"}}')
    got = {r.id: r for r in reports.read_nodes_typed(spark, f"{tmp_path}/n.json").collect()}
    assert got["id1"].seq == 3 and got["id1"].record == '{"eth":[1,{"x":2}]}' and got["id1"].score == 7 and got["id2"].record == "enr:-abc"
    assert (got["id1"].last_response - got["id1"].first_response).days == 1 and got["id2"].last_check is None


def test_bitsets_reject_what_they_did_not_make():
    data = bytes([0] * 30 + [5] + [0] * 20 + [9])
    packed = codecs.bits_compress(data)
    assert codecs.bits_decompress(packed, len(data)) == data
    for bad in (packed[:-1], packed + b"\x01", packed[:-1] + b"\0", b"\xff" * 60):
        with pytest.raises(ValueError):
            codecs.bits_decompress(bad, len(data))


def test_columns_of_codes(spark):
    assert codecs.selector("transfer(address, uint256)").hex() == "a9059cbb"
    assert codecs.signature_hash("Transfer(address,address,uint256)").hex() == "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert codecs.topic_of("uint8", 5) == b"\0" * 31 + b"\x05" and codecs.topic_of("int256", -1) == b"\xff" * 32 and codecs.topic_of("bool", True)[-1] == 1
    assert codecs.topic_of("bytes4", b"abcd") == b"abcd" + b"\0" * 28 and codecs.topic_of("string", "x") == keccak256([b"x"])[0] and codecs.topic_of("address", b"a" * 20) == b"\0" * 12 + b"a" * 20
    with pytest.raises(ValueError):
        codecs.topic_of("(uint8)", 1)
    df = spark.createDataFrame([(rlp_encode([b"a", [b"b", b"c"], b""]),), (b"\xc2a",), (None,), (rlp_encode(b"abc"),)], "x binary")
    got = [r[0] for r in df.select(codecs.rlp_items("x")).collect()]
    assert [None if g is None else [bytes(x) for x in g] for g in got] == [[b"a", rlp_encode([b"b", b"c"]), b""], None, None, None]
    df = spark.createDataFrame([("0x1F",), ("abc",), ("zz",), (None,), ("",)], "t string")
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(codecs.from_hex(F.col("t"))).collect()] == [b"\x1f", b"\x0a\xbc", None, None, b""]
    word = (b"\0" * 31 + b"\x05") + (b"\0" * 31 + b"\x40") + (b"\0" * 31 + b"\x02") + b"hi" + b"\0" * 30
    df = spark.createDataFrame([(word,), (word[:40],)], "x binary")
    assert [r[0] for r in df.select(codecs.abi_values(["uint8", "string"])("x")).collect()] == [["5", "hi"], None]
