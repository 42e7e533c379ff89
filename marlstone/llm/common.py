"""Shared kernels: Arrow text buffers, word hashing, joins of hot keys, names that don't clash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.checkpoints import checkpointed  # noqa: F401, for all operators here

#: Bytes of the class [\x20\x09-\x0D]; bytes.split() without an argument splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


#: A key with over 1/HOT_KEYS of all rows takes the broadcast way of join_keys; there are fewer than HOT_KEYS such keys.
HOT_KEYS = 1000


def join_keys(rows: DataFrame, keys: DataFrame, on: str | list[str], size: str) -> DataFrame:
    """rows joined to keys, which has one row for each value of `on`; `size` is how many rows have it, or more.

    The hot keys are broadcast, so that their rows stay where they are instead of
    meeting in one task; the others are joined as usual. Which they are is asked
    first: a list of fewer than HOT_KEYS numbers, by the first of several columns.
    Without any there is one plain join; with some both tables are read twice. The
    first column holds whole numbers, and no column nulls.
    """
    on = [on] if isinstance(on, str) else on
    total, most = keys.agg(F.sum(size), F.max(size)).first()
    if not total or most * HOT_KEYS <= total:
        return rows.join(keys, on)
    hot = [r[0] for r in keys.where(F.col(size) * HOT_KEYS > total).select(on[0]).distinct().collect()]
    is_hot = F.expr(f"`{on[0]}` IN ({', '.join(f'{int(x)}L' for x in hot)})")
    return rows.where(is_hot).join(F.broadcast(keys.where(is_hot)), on).unionByName(rows.where(~is_hot).join(keys.where(~is_hot), on))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no such column."""
    have = {c.lower() for c in df.columns}
    bar = "_"
    while any(bar + n.lower() in have for n in names):
        bar += "_"
    return [bar + n for n in names]


def set_aside(df: DataFrame, *names: str):
    """df with columns of these names renamed, and a function that undoes it and selects df's columns."""
    clash = [c for c in df.columns if c.lower() in names]
    away = dict(zip(clash, unused(df, *clash), strict=True))
    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{away.get(c, c)}`").alias(c) for c in df.columns])

    return df.withColumnsRenamed(away), back


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a lambda would compute it anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null gives b''."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column, without a copy of the text; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return offsets, data


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values over each slice between neighbouring offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) -> its 64-bit hash, eight bytes little endian. Remembers the first `limit` words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh64_intdigest(word).to_bytes(8, "little")
        if len(word) <= 64 and len(self) < self.limit:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8")


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n word hashes; one of the whole sequence if it is shorter."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    with np.errstate(over="ignore"):
        h = np.full(len(hashes) - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            h = mix((h + GOLDEN) ^ hashes[i : len(hashes) - k + 1 + i])
    return h

