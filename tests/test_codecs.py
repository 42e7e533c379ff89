import heapq
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.functions import codecs
from marlstone.operators import bloom, pool
from marlstone.sources import dumps
from marlstone.streaming import streams


def test_keccak():
    # Published digests of the empty string and "abc".
    got = codecs.keccak256([b"", b"abc", b"x" * 135, b"x" * 136, b"x" * 500])
    assert got[0].hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert got[1].hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    assert got[2:] == [codecs.keccak256([b"x" * n])[0] for n in (135, 136, 500)]


def test_rlp_round_trip():
    r = random.Random(0)
    make = lambda depth: r.randbytes(r.choice([0, 1, 1, 2, 55, 56, 300])) if depth == 0 or r.random() < 0.5 else [make(depth - 1) for _ in range(r.randrange(4))]
    for _ in range(300):
        x = make(3)
        data = codecs.rlp_encode(x)
        assert codecs.rlp_decode(data) == (x, len(data))
    for bad in (b"\x81\x01", b"\xb8\x01a", b"\x83ab", b""):
        with pytest.raises(ValueError):
            codecs.rlp_decode(bad)


def test_abi():
    word = lambda n: n.to_bytes(32, "big", signed=n < 0)
    data = word(7) + word(-2) + word(1) + word(128) + word(3) + b"abc".ljust(32, b"\0")
    assert codecs.abi_decode(["uint256", "int8", "bool", "string"], data) == [7, -2, True, "abc"]
    data = word(64) + b"\x01\x02".ljust(32, b"\0") + word(2) + word(5) + word(6)
    assert codecs.abi_decode(["uint8[]", "bytes2"], data) == [[5, 6], b"\x01\x02"]


def test_sparse_bits():
    r = random.Random(2)
    for n in (1, 2, 9, 64, 513):
        for share in (0, 0.01, 0.3, 1):
            x = bytes(r.randrange(1, 256) if r.random() < share else 0 for _ in range(n))
            assert codecs.bits_decompress(codecs.bits_compress(x), n) == x


def test_dump_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, bytearray(b"k1"), bytearray(b"v1")), (1, bytearray(b"k2"), bytearray(b""))], "op int, key binary, value binary").coalesce(1)
    for compress in (True, False):
        dumps.write_dump(rows, f"{tmp_path}/d", b"magic", b"preimage", compress)
        got = dumps.read_dump(spark.read.parquet(f"{tmp_path}/d"), b"magic").collect()
        assert [(r.kind, r.op, bytes(r.key), bytes(r.value)) for r in got] == [("preimage", 0, b"k1", b"v1"), ("preimage", 1, b"k2", b"")]
    data = dumps.dump_bytes([(0, b"a", b"b")] * 3, b"magic", b"x")
    assert len(list(dumps.parse_dump(data, b"magic", skip=2))) == 1
    with pytest.raises(ValueError):
        list(dumps.parse_dump(data, b"other"))
    with pytest.raises(ValueError):
        list(dumps.parse_dump(codecs.rlp_encode([b"magic", b"\x01", b"x", b""]), b"magic"))


def test_abi_tuples_and_fixed_arrays():
    word = lambda *xs: b"".join(x.to_bytes(32, "big", signed=x < 0) for x in xs)
    text = word(3) + b"abc".ljust(32, b"\0")
    assert codecs.abi_decode(["uint8[2]", "(int8,bool)", "uint8"], word(1, 2, -3, 1, 9)) == [[1, 2], [-3, True], 9]
    assert codecs.abi_decode(["uint8", "(uint8,string)"], word(1, 64, 2, 64) + text) == [1, [2, "abc"]]
    assert codecs.abi_decode(["string[2]"], word(32, 64, 128) + text + text) == [["abc", "abc"]]
    assert codecs.abi_decode(["(uint8,uint8[2])[]"], word(32, 2, 1, 2, 3, 4, 5, 6)) == [[[1, [2, 3]], [4, [5, 6]]]]
    assert codecs.abi_decode(["uint8[0]", "uint8[][]"], word(32, 1, 32, 1, 7)) == [[], [[7]]]
    assert codecs.abi_fields("(a,(b,c[2])[],())") == ["a", "(b,c[2])[]", "()"]
    for kinds, data in ((["uint8[2]"], word(1)), (["string"], word(32, 40) + b"x"), (["uint8[]"], word(32, 1 << 200))):
        with pytest.raises(ValueError):
            codecs.abi_decode(kinds, data)


def framed(parts, kind):
    chunk = lambda k, x: bytes([k]) + len(x).to_bytes(3, "little") + x
    body = lambda x: b"\0\0\0\0" + (x if kind else pa.compress(x, codec="snappy", asbytes=True))
    return dumps.SNAPPY_START + chunk(0xFE, b"pad") + b"".join(chunk(kind, body(x)) for x in parts)


def test_framed_entries(spark, tmp_path):
    parts = [b"ab" * 30000, b"", b"tail"]
    for kind in (0, 1):
        assert dumps.unframe(framed(parts, kind)) == b"".join(parts)
    assert dumps.unframe(b"plain") == b"plain"
    for bad in (framed(parts, 0)[:-1], dumps.SNAPPY_START + b"\x05\0\0\0", dumps.SNAPPY_START + b"\0\1\0\0x"):
        with pytest.raises(ValueError):
            dumps.unframe(bad)
    entry = lambda t, x: t + len(x).to_bytes(4, "little") + b"\0\0" + x
    (tmp_path / "a").write_bytes(entry(b"\x03\0", framed(parts, 0)) + entry(b"\x06\0", b"plain"))
    files = spark.read.format("binaryFile").load(f"{tmp_path}/a")
    got = dumps.read_entries(files, expand=True).orderBy("place").collect()
    assert [bytes(r.data) for r in got] == [b"".join(parts), b"plain"]


def test_entries_and_epochs(spark, tmp_path):
    entry = lambda t, x: t + len(x).to_bytes(4, "little") + b"\0\0" + x
    (tmp_path / "a").write_bytes(entry(b"e2", b"") + entry(b"\x03\0", b"data"))
    got = dumps.read_entries(spark.read.format("binaryFile").load(f"{tmp_path}/a")).orderBy("place").collect()
    assert [(r.type, bytes(r.data)) for r in got] == [("6532", b""), ("0300", b"data")]
    blocks = spark.range(100).select(F.col("id").alias("block_number"), F.lit("x").alias("v"))
    dumps.export_epochs(blocks, f"{tmp_path}/e", 40)
    assert {r.epoch: r.n for r in dumps.epoch_checksums(spark, f"{tmp_path}/e").collect()} == {0: 40, 1: 40, 2: 20}


def test_bloom_candidates_hold_all_matches(spark):
    r = random.Random(1)
    logs = [(b, f"a{r.randrange(30)}".encode(), f"t{r.randrange(5)}".encode()) for b in range(100) for _ in range(3)]
    df = spark.createDataFrame([(b, bytearray(a), bytearray(t)) for b, a, t in logs], "block_number long, a binary, t binary")
    bits = bloom.set_bits(df, ["a", "t"])
    got = {x.block_number for x in bloom.candidates(bloom.index(bits, 16), [[b"a3", b"a4"], [], [b"t1"]], 16).collect()}
    assert {b for b, a, t in logs if a in (b"a3", b"a4") and t == b"t1"} <= got and len(got) < 60
    assert all(len(x.bloom) == 256 for x in bloom.filters(bits).collect())
    with pytest.raises(ValueError):
        bloom.candidates(bits, [[]])


def test_merge_by_price(spark):
    r = random.Random(3)
    prices = r.sample(range(1000), 60)
    rows = [(i % 7, i // 7, prices[i], i) for i in range(60)]
    accounts = {a: sorted((n, p, t) for b, n, p, t in rows if b == a) for a in range(7)}
    heap = [(-v[0][1], v[0][2], a, 0) for a, v in accounts.items()]
    heapq.heapify(heap)
    want = []
    while heap:
        _, _, a, n = heapq.heappop(heap)
        want.append((a, n))
        if n + 1 < len(accounts[a]):
            heapq.heappush(heap, (-accounts[a][n + 1][1], accounts[a][n + 1][2], a, n + 1))
    got = pool.by_price(spark.createDataFrame(rows, "account long, nonce long, price long, time long")).collect()
    assert [(x.account, x.nonce) for x in got] == want


def test_stream_pairs_keep_state_between_batches(spark, tmp_path):
    keys = [f"k{i % 5}" for i in range(30)]
    for part in range(3):
        spark.createDataFrame([(1, i, keys[i]) for i in range(part * 10, part * 10 + 10)], "segment_id long, seq long, key string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.read(spark, f"{tmp_path}/in")
        out = streams.pairs(stream, 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        out.awaitTermination()
    got = {r.seq: (r.k1, r.k2) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: tuple(sorted((keys[i], keys[i - 4]))) for i in range(4, 30)}


def test_masks_and_trims(spark):
    df = spark.createDataFrame([("10.4.0.1",), ("10.6.0.1",), ("9.255.255.255",)], "ip string")
    assert [r[0] for r in df.select(codecs.in_network(F.col("ip"), "10.4.0.0/15")).collect()] == [True, False, False]
    x = spark.range(1).select(F.unhex(F.lit("0000ab00")).alias("b"))
    assert x.select(F.hex(codecs.trim_zeros(F.col("b"))), F.hex(codecs.trim_zeros(F.col("b"), False))).first() == ("AB00", "0000AB")
    assert dumps.metric_lines(spark.createDataFrame([("m", 5, 1.5)], "name string, ts long, v double"), "x").first().value == "x,name=m v=1.5 5"
