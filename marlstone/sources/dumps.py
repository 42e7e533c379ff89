"""Dumps of key-value pairs as streams of RLP items, archives of typed entries, and exports by range."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.codecs import rlp_decode, rlp_encode

ADD, DELETE = 0, 1


def _number(x: bytes) -> int:
    return int.from_bytes(x, "big")


def _bytes(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def dump_bytes(rows: list[tuple[int, bytes, bytes]], magic: bytes, kind: bytes, at: int = 0) -> bytes:
    """A header (magic, version 0, kind, unix time) and (op, key, value) after it."""
    return rlp_encode([magic, b"", kind, _bytes(at)]) + b"".join(rlp_encode([_bytes(op), k, v]) for op, k, v in rows)


def write_dump(rows: DataFrame, path: str, magic: bytes, kind: bytes, compress: bool = True) -> None:
    """rows (op, key, value) as one dump for each partition: a table of (name, content) in Parquet, for a store that takes bytes.

    A partition is one value in memory, 2 GB at most: repartition rows to suit.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        body = dump_bytes([(int(o), bytes(k), bytes(v or b"")) for p in parts for o, k, v in zip(p["op"], p["key"], p["value"], strict=True)], magic, kind)
        yield pd.DataFrame({"name": [f"part-{TaskContext.get().partitionId():05d}.rlp" + ".gz" * compress], "content": [gzip.compress(body, mtime=0) if compress else body]})

    rows.select("op", "key", "value").mapInPandas(run, "name string, content binary").write.mode("overwrite").parquet(path)


def parse_dump(content: bytes, magic: bytes, skip: int = 0) -> Iterator[tuple[bytes, int, bytes, bytes]]:
    """(kind, op, key, value) of a dump, gzipped or not; another magic or a later version is an error."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    (found, version, kind, _), at = rlp_decode(data)
    if found != magic:
        raise ValueError("not such a dump")
    if _number(version) > 0:
        raise ValueError("a later version")
    n = 0
    while at < len(data):
        (op, key, value), at = rlp_decode(data, at)
        n += 1
        if n > skip:
            yield kind, _number(op), key, value


def read_dump(files: DataFrame, magic: bytes, skip: int = 0) -> DataFrame:
    """(kind, op, key, value) of files (content), such as spark.read.format("binaryFile") gives; a file is one value, 2 GB at most."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for content in p["content"]:
                rows = list(parse_dump(bytes(content), magic, skip))
                yield pd.DataFrame({"kind": [r[0].decode() for r in rows], "op": [r[1] for r in rows], "key": [r[2] for r in rows], "value": [r[3] for r in rows]})

    return files.select("content").mapInPandas(run, "kind string, op int, key binary, value binary")


#: The first chunk of a Snappy framed stream.
SNAPPY_START = b"\xff\x06\x00\x00sNaPpY"


def unframe(data: bytes) -> bytes:
    """A Snappy framed stream, decompressed; anything else stays as it is. Checksums of chunks aren't tested."""
    if not data.startswith(SNAPPY_START):
        return data
    out, at = [], 0
    while at < len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        chunk = data[at + 4 : at + 4 + size]
        if at + 4 + size > len(data) or 2 <= kind < 0x80 or kind < 2 and size < 4:
            raise ValueError(f"bad chunk at {at}")
        if kind == 1:
            out.append(chunk[4:])
        elif kind == 0:
            n = shift = 0
            for b in chunk[4:9]:
                n |= (b & 0x7F) << shift
                shift += 7
                if b < 0x80:
                    break
            if n > 1 << 16:
                raise ValueError(f"bad chunk at {at}")
            out.append(pa.decompress(chunk[4:], decompressed_size=n, codec="snappy", asbytes=True))
        at += 4 + size
    return b"".join(out)


def read_entries(files: DataFrame, expand: bool = False) -> DataFrame:
    """(path, place, type, data) of archives of entries: a two-byte type, a four-byte little-endian length, two zero bytes, data.

    With expand, data that is a Snappy framed stream comes decompressed.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, content in zip(p["path"], p["content"], strict=True):
                data, at, rows = bytes(content), 0, []
                while at < len(data):
                    size = int.from_bytes(data[at + 2 : at + 6], "little")
                    if data[at + 6 : at + 8] != b"\0\0" or at + 8 + size > len(data):
                        raise ValueError(f"bad entry at {at} of {path}")
                    body = data[at + 8 : at + 8 + size]
                    rows.append((path, len(rows), data[at : at + 2].hex(), unframe(body) if expand else body))
                    at += 8 + size
                yield pd.DataFrame(rows, columns=["path", "place", "type", "data"])

    return files.select("path", "content").mapInPandas(run, "path string, place int, type string, data binary")


def export_epochs(blocks: DataFrame, path: str, size: int = 8192) -> None:
    """Blocks in a folder for each range of `size` numbers, in order."""
    by = blocks.withColumn("epoch", F.floor(F.col("block_number") / size))
    by.repartition("epoch").sortWithinPartitions("epoch", "block_number").write.mode("overwrite").partitionBy("epoch").parquet(path)


def epoch_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, n, checksum): n rows, and in hex the sums modulo 2**64 of two hashes of each row, in any order; rows that repeat count each time."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "epoch"]
    halves = lambda h: (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))
    first, second = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    sums = [F.sum(x).alias(f"_{i}") for i, x in enumerate((*halves(first), *halves(second)))]  # of 32 bits each: 2**31 rows fit
    hexed = lambda c: F.lpad(F.lower(F.hex(F.col(c))), 16, "0")
    return rows.groupBy("epoch").agg(F.count("*").alias("n"), *sums).select("epoch", "n", F.concat(*[hexed(f"_{i}") for i in range(4)]).alias("checksum"))


def read_epochs(spark: SparkSession, path: str, checksums: DataFrame | None = None) -> DataFrame:
    """Exported blocks; with checksums (epoch, n, checksum), an epoch that doesn't match, or is missing, is an error."""
    if checksums is not None:
        now = epoch_checksums(spark, path)
        bad = checksums.select("epoch", "n", "checksum").exceptAll(now.select(*[F.col(c).cast(checksums.schema[c].dataType) for c in ("epoch", "n", "checksum")]))
        if wrong := bad.select("epoch").limit(5).collect():
            raise ValueError(f"epochs that don't match: {sorted(r[0] for r in wrong)}")
    return spark.read.parquet(path)


#: Types of entries of a block archive, two bytes in hex.
ENTRY = {"version": "6532", "header": "0300", "body": "0400", "receipts": "0500", "difficulty": "0600", "accumulator": "0700", "index": "6632"}
BLOCK = "path string, number long, hash binary, parent_hash binary, miner binary, gas_limit long, gas_used long, ts long, base_fee string, n_txs int, n_uncles int, txs array<binary>, receipts array<struct<status:int,cumulative_gas_used:long,n_logs:int>>, difficulty string"


def decode_block(header: bytes, body: bytes, receipts: bytes, difficulty: bytes) -> tuple:
    """BLOCK without the path, from the four entries of a block. Typed transactions and receipts are byte strings of a type and a list."""
    from marlstone.functions.codecs import keccak256

    h, (txs, uncles, *_), found = rlp_decode(header)[0], rlp_decode(body)[0], []
    for r in rlp_decode(receipts)[0]:
        status, gas, _, logs = rlp_decode(r[1:])[0] if isinstance(r, bytes) else r
        found.append((_number(status) if len(status) <= 1 else None, _number(gas), len(logs)))
    raw = [t if isinstance(t, bytes) else rlp_encode(t) for t in txs]
    fee = str(_number(h[15])) if len(h) > 15 else None
    return (_number(h[8]), keccak256([header])[0], h[0], h[2], _number(h[9]), _number(h[10]), _number(h[11]), fee, len(raw), len(uncles), raw, found, str(int.from_bytes(difficulty, "little")))


def read_blocks(files: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """BLOCK of each block in archives (path, content), decoded entry after entry; blocks outside [first, last] aren't decoded.

    An archive's index gives the number of its first block, so that only the wanted
    entries are looked into. A file is one value: 2 GB at most.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, content in zip(p["path"], p["content"], strict=True):
                yield pd.DataFrame([(path, *row) for row in blocks_of(bytes(content), path, first, last)], columns=[f.split(" ")[0] for f in BLOCK.split(", ")])

    return files.select("path", "content").mapInPandas(run, BLOCK)


def entries_of(data: bytes, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(type, start, end) of the data of each entry."""
    at = 0
    while at < len(data):
        size = int.from_bytes(data[at + 2 : at + 6], "little")
        if data[at + 6 : at + 8] != b"\0\0" or at + 8 + size > len(data):
            raise ValueError(f"bad entry at {at} of {path}")
        yield data[at : at + 2].hex(), at + 8, at + 8 + size
        at += 8 + size


def blocks_of(data: bytes, path: str, first: int | None, last: int | None) -> Iterator[tuple]:
    entries = list(entries_of(data, path))
    index = [data[a:b] for kind, a, b in entries if kind == ENTRY["index"]]
    start = int.from_bytes(index[0][:8], "little") if index else None
    group: dict[str, bytes] = {}
    nth = 0
    for kind, a, b in entries:
        if kind not in (ENTRY["header"], ENTRY["body"], ENTRY["receipts"], ENTRY["difficulty"]):
            continue
        group[kind] = data[a:b]
        if kind == ENTRY["difficulty"]:  # the last of a block
            number, nth = None if start is None else start + nth, nth + 1
            if number is None or (first is None or number >= first) and (last is None or number <= last):
                row = decode_block(*(unframe(group[ENTRY[k]]) for k in ("header", "body", "receipts")), group[ENTRY["difficulty"]])
                if (first is None or row[0] >= first) and (last is None or row[0] <= last):
                    yield row
            group = {}


def dump_accounts(accounts: DataFrame, path: str, code: bool = True, storage: bool = True, addresses_only: bool = False) -> None:
    """Accounts as JSON lines, without code or storage on request, or only those whose address is known."""
    kept_accounts(accounts, code, storage, addresses_only).write.mode("overwrite").json(path)


def kept_accounts(accounts: DataFrame, code: bool = True, storage: bool = True, addresses_only: bool = False) -> DataFrame:
    out = accounts.where(F.col("address").isNotNull()) if addresses_only else accounts
    return out.drop(*["code"] * (not code), *["storage"] * (not storage))


def dump_whole(accounts: DataFrame, root: str, key: str, path: str, **flags) -> None:
    """A state as JSON objects {"root", "accounts": {key: account}}, one a partition: each is one value in memory."""
    kept = kept_accounts(accounts, **flags)
    each = kept.select(F.col(key).cast("string").alias("k"), F.struct(*[c for c in kept.columns if c != key]).alias("account"), F.spark_partition_id().alias("p"))
    whole = each.groupBy("p").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "account")))).alias("accounts"))
    whole.select(F.lit(root).alias("root"), "accounts").write.mode("overwrite").json(path)


def _pairs(metrics: DataFrame) -> list[str]:
    return [c for c in metrics.columns if c not in ("name", "ts")]


def metric_lines(metrics: DataFrame, measurement: str) -> DataFrame:
    """One line `measurement,name=<name> field=value,... ts` for each row of (name, ts seconds, numbers)."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in _pairs(metrics)])
    return metrics.select(F.concat(F.lit(f"{measurement},name="), "name", F.lit(" "), pairs, F.lit(" "), F.col("ts").cast("string")).alias("value"))


def prometheus_text(metrics: DataFrame) -> DataFrame:
    """`# TYPE name_field gauge` and `name_field value` for each number of each row; characters that names can't have become _."""
    name = lambda c: F.regexp_replace(F.concat("name", F.lit(f"_{c}")), "[^a-zA-Z0-9_:]", "_")
    lines = [F.concat(F.lit("# TYPE "), name(c), F.lit(" gauge\n"), name(c), F.lit(" "), F.col(c).cast("string")) for c in _pairs(metrics)]
    return metrics.select(F.array_join(F.array(*lines), "\n").alias("value"))


def graphite_lines(metrics: DataFrame, prefix: str) -> DataFrame:
    """`prefix.name.field value ts`, a line for each number."""
    lines = [F.concat(F.lit(f"{prefix}."), "name", F.lit(f".{c} "), F.col(c).cast("string"), F.lit(" "), F.col("ts").cast("string")) for c in _pairs(metrics)]
    return metrics.select(F.explode(F.array(*lines)).alias("value"))


def opentsdb_lines(metrics: DataFrame, prefix: str, host: str) -> DataFrame:
    """`put prefix.name.field ts value host=host`, a line for each number."""
    lines = [F.concat(F.lit(f"put {prefix}."), "name", F.lit(f".{c} "), F.col("ts").cast("string"), F.lit(" "), F.col(c).cast("string"), F.lit(f" host={host}")) for c in _pairs(metrics)]
    return metrics.select(F.explode(F.array(*lines)).alias("value"))


def read_metric_lines(lines: DataFrame) -> DataFrame:
    """(name, field, v, ts) of metric_lines."""
    parts = F.split("value", " ")
    fields = F.transform(F.split(F.get(parts, F.lit(1)), ","), lambda x: F.struct(F.substring_index(x, "=", 1).alias("field"), F.substring_index(x, "=", -1).cast("double").alias("v")))
    return lines.select(F.regexp_extract("value", ",name=([^ ]*) ", 1).alias("name"), F.get(parts, F.lit(2)).cast("long").alias("ts"), F.inline(fields))
