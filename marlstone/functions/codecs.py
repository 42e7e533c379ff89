"""Keccak-256, RLP, fixed-width ABI words, sparse bitsets and address masks; numpy or plain Python over Arrow batches."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _round_constants() -> list[int]:
    """From the linear feedback shift register of the published standard."""
    out, lfsr = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if lfsr & 1:
                value |= 1 << ((1 << j) - 1)
            lfsr = (lfsr << 1) ^ (0x171 if lfsr & 0x80 else 0)
        out.append(value)
    return out


def _rotations() -> np.ndarray:
    """Rotation of lane (x, y) at [x + 5 * y]."""
    out, x, y = np.zeros(25, np.uint64), 1, 0
    for t in range(24):
        out[x + 5 * y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


ROUNDS, TURNS = _round_constants(), _rotations()
MOVED = np.array([y + 5 * ((2 * x + 3 * y) % 5) for y in range(5) for x in range(5)])


def rotate(a: np.ndarray, n) -> np.ndarray:
    n = np.uint64(n) if np.isscalar(n) else n
    return (a << n) | (a >> ((np.uint64(64) - n) & np.uint64(63)))


def keccak_f(a: np.ndarray) -> np.ndarray:
    """The permutation of states (n, 25)."""
    for constant in ROUNDS:
        c = np.bitwise_xor.reduce(a.reshape(-1, 5, 5), axis=1)
        a = a ^ np.tile(np.roll(c, 1, 1) ^ rotate(np.roll(c, -1, 1), 1), 5)
        b = np.empty_like(a)
        b[:, MOVED] = rotate(a, TURNS)
        rows = b.reshape(-1, 5, 5)
        a = (rows ^ (~np.roll(rows, -1, 2) & np.roll(rows, -2, 2))).reshape(-1, 25)
        a[:, 0] ^= np.uint64(constant)
    return a


def keccak256(values: list[bytes], rate: int = 136) -> list[bytes]:
    """Digests of many values, those of as many blocks together."""
    out: list[bytes] = [b""] * len(values)
    by_blocks: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        by_blocks.setdefault(len(v) // rate + 1, []).append(i)
    for blocks, rows in by_blocks.items():
        data = np.zeros((len(rows), blocks * rate), np.uint8)
        for r, i in zip(data, rows, strict=True):
            r[: len(values[i])] = np.frombuffer(values[i], np.uint8)
            r[len(values[i])] ^= 1
            r[-1] ^= 0x80
        state = np.zeros((len(rows), 25), np.uint64)
        for block in data.reshape(len(rows), blocks, rate).transpose(1, 0, 2):
            state[:, : rate // 8] ^= np.ascontiguousarray(block).view("<u8")
            state = keccak_f(state)
        for i, s in zip(rows, state, strict=True):
            out[i] = s[:4].astype("<u8").tobytes()
    return out


@F.pandas_udf(T.BinaryType())
def keccak(values: pd.Series) -> pd.Series:
    """Keccak-256 of a binary column; null stays null."""
    found = values.notna()
    digests = iter(keccak256([bytes(v) for v in values[found]]))
    return pd.Series([next(digests) if ok else None for ok in found])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def bloom_bits(values: pd.Series) -> pd.Series:
    """The three of 2048 bits that a value sets; null sets none."""
    found = values.notna()
    digests = iter(keccak256([bytes(v) for v in values[found]]))
    three = lambda h: [int.from_bytes(h[i : i + 2], "big") & 2047 for i in (0, 2, 4)]
    return pd.Series([three(next(digests)) if ok else [] for ok in found])


def rlp_encode(x) -> bytes:
    """bytes or a (nested) list of them."""
    body, base = (x, 0x80) if isinstance(x, bytes) else (b"".join(map(rlp_encode, x)), 0xC0)
    if base == 0x80 and len(body) == 1 and body[0] < 0x80:
        return body
    if len(body) < 56:
        return bytes([base + len(body)]) + body
    size = len(body).to_bytes((len(body).bit_length() + 7) // 8, "big")
    return bytes([base + 55 + len(size)]) + size + body


def rlp_decode(data: bytes, at: int = 0):
    """(value, end) of the item at `at`; a form longer than need be, or cut off, is an error."""
    if at >= len(data):
        raise ValueError("cut off")
    first = data[at]
    if first < 0x80:
        return data[at : at + 1], at + 1
    base = 0x80 if first < 0xC0 else 0xC0
    short = first - base
    if short < 56:
        start, size = at + 1, short
    else:
        start = at + 1 + short - 55
        size = int.from_bytes(data[at + 1 : start], "big")
        if size < 56 or data[at + 1] == 0:
            raise ValueError("not the shortest form")
    end = start + size
    if end > len(data):
        raise ValueError("cut off")
    if base == 0x80:
        if short == 1 and data[start] < 0x80:
            raise ValueError("not the shortest form")
        return data[start:end], end
    items = []
    while start < end:
        item, start = rlp_decode(data[:end], start)
        items.append(item)
    return items, end


def abi_fields(kind: str) -> list[str]:
    """Types of a tuple (T1,T2,...), split at its own commas."""
    fields, depth = [""], 0
    for c in kind[1:-1]:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            fields.append("")
        else:
            fields[-1] += c
    return fields if kind != "()" else []


def abi_width(kind: str) -> int | None:
    """Bytes of a value in place; None for values of no fixed size, which stand elsewhere."""
    if kind in ("bytes", "string") or kind.endswith("[]"):
        return None
    if kind.endswith("]"):
        inner, n = kind[:-1].rsplit("[", 1)
        parts = [abi_width(inner)] * int(n)
    elif kind.startswith("("):
        parts = [abi_width(f) for f in abi_fields(kind)]
    else:
        return 32
    return None if None in parts else sum(parts)


def abi_decode(kinds: list[str], data: bytes) -> list:
    """uintN, intN, bool, address, bytesN, bytes, string, T[], T[n] and (T1,T2,...) arguments; arrays and tuples come as lists."""

    def word(at: int) -> bytes:
        if at + 32 > len(data):
            raise ValueError("cut off")
        return data[at : at + 32]

    def number(at: int) -> int:
        return int.from_bytes(word(at), "big")

    def many(kinds: Iterable[str], base: int) -> list:
        at, out = base, []
        for kind in kinds:
            width = abi_width(kind)
            out.append(one(kind, base + number(at) if width is None else at))
            at += 32 if width is None else width
        return out

    def one(kind: str, at: int):
        if kind.endswith("[]"):
            if number(at) > len(data):
                raise ValueError("cut off")
            return many(repeat(kind[:-2], number(at)), at + 32)
        if kind.endswith("]"):
            inner, n = kind[:-1].rsplit("[", 1)
            return many(repeat(inner, int(n)), at)
        if kind.startswith("("):
            return many(abi_fields(kind), at)
        if kind in ("bytes", "string"):
            body = data[at + 32 : at + 32 + number(at)]
            if len(body) < number(at):
                raise ValueError("cut off")
            return body.decode() if kind == "string" else body
        if kind == "bool":
            return bool(number(at))
        if kind == "address":
            return word(at)[12:]
        if kind.startswith("bytes"):
            return word(at)[: int(kind[5:])]
        return int.from_bytes(word(at), "big", signed=kind.startswith("int"))

    return many(kinds, 0)


def bits_compress(data: bytes) -> bytes:
    """Non-zero bytes and, before them, a bitset of where they are, itself compressed; whichever is shorter."""

    def pack(x: bytes) -> bytes:
        if not any(x):
            return b""
        if len(x) == 1:
            return x
        marks = np.packbits(np.frombuffer(x, np.uint8) != 0).tobytes()
        return pack(marks) + bytes(b for b in x if b)

    out = pack(data)
    return out if len(out) < len(data) else data


def bits_decompress(data: bytes, size: int) -> bytes:
    """The `size` bytes that bits_compress was given. Data that ends early, has bytes left over, marks places beyond the end or holds a marked zero is an error."""
    if len(data) == size:
        return data
    if len(data) > size:
        raise ValueError("longer than what it stands for")

    def unpack(at: int, n: int) -> tuple[bytes, int]:
        if n == 0 or not data:
            return bytes(n), at
        if n == 1:
            if at >= len(data):
                raise ValueError("cut off")
            return data[at : at + 1], at + 1
        marks, at = unpack(at, -(-n // 8))
        bits = np.unpackbits(np.frombuffer(marks, np.uint8))
        if bits[n:].any():
            raise ValueError("a place beyond the end")
        where, out = np.flatnonzero(bits[:n]), np.zeros(n, np.uint8)
        if at + len(where) > len(data):
            raise ValueError("cut off")
        out[where] = np.frombuffer(data[at : at + len(where)], np.uint8)
        if (out[where] == 0).any():
            raise ValueError("a marked byte is zero")
        return out.tobytes(), at + len(where)

    out, end = unpack(0, size)
    if end != len(data):
        raise ValueError("bytes left over")
    return out


def left_pad(data: Column, n: int) -> Column:
    """Binary with zero bytes before it up to n; what is longer stays."""
    return F.when(F.octet_length(data) >= n, data).otherwise(F.lpad(data, n, F.lit(b"\0")))


def right_pad(data: Column, n: int) -> Column:
    return F.when(F.octet_length(data) >= n, data).otherwise(F.rpad(data, n, F.lit(b"\0")))


def from_hex(text: Column) -> Column:
    """Binary of hex digits, with or without 0x; an odd number of them gets a zero in front; null if it isn't hex."""
    digits = F.regexp_replace(text, "^0[xX]", "")
    return F.try_to_binary(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits), F.lit("hex"))


def to_hex(data: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(data)))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def rlp_items(values: pd.Series) -> pd.Series:
    """The items of an encoded list; those that are lists themselves stay encoded. What isn't one whole list gives null."""

    def items(value) -> list[bytes] | None:
        try:
            found, end = rlp_decode(bytes(value))
        except ValueError:
            return None
        return [x if isinstance(x, bytes) else rlp_encode(x) for x in found] if isinstance(found, list) and end == len(value) else None

    return values.map(items, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def rlp_list(values: pd.Series) -> pd.Series:
    """An array of binaries as an encoded list."""
    return values.map(lambda xs: rlp_encode([bytes(x) for x in xs]), na_action="ignore")


def abi_values(kinds: list[str]):
    """A column function: arguments of the types `kinds` as an array of strings (numbers in decimal, bytes in hex, others as JSON); null if they don't decode."""
    import json

    def said(x) -> str:
        if isinstance(x, bytes):
            return "0x" + x.hex()
        return x if isinstance(x, str) else json.dumps(x, default=said) if isinstance(x, list) else str(x).lower() if isinstance(x, bool) else str(x)

    def decoded(value) -> list[str] | None:
        try:
            return [said(x) for x in abi_decode(kinds, bytes(value))]
        except (ValueError, UnicodeDecodeError):
            return None

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(decoded, na_action="ignore")

    return run


def signature_hash(signature: str) -> bytes:
    """The topic of an event, name(type,...)."""
    return keccak256([signature.replace(" ", "").encode()])[0]


def selector(signature: str) -> bytes:
    """The first four bytes of a call of a method, name(type,...)."""
    return signature_hash(signature)[:4]


def topic_of(kind: str, value) -> bytes:
    """An indexed argument as a topic of 32 bytes: numbers and bools padded on the left, bytesN on the right, string and bytes by hash."""
    if kind in ("string", "bytes"):
        return keccak256([value.encode() if isinstance(value, str) else value])[0]
    if kind == "bool" or kind.startswith(("uint", "int")):
        return (int(value) % (1 << 256)).to_bytes(32, "big")
    if kind == "address":
        return value.rjust(32, b"\0")
    if kind.startswith("bytes"):
        return value.ljust(32, b"\0")
    raise ValueError(f"no topic for {kind}")


def ipv4_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return reduce(lambda n, i: n * 256 + F.get(parts, F.lit(i)).cast("long"), range(4), F.lit(0).cast("long"))


def in_network(ip: Column, cidr: str) -> Column:
    """Whether a dotted IPv4 address lies in a network, by its range of numbers."""
    net = ipaddress.ip_network(cidr)
    return ipv4_number(ip).between(int(net.network_address), int(net.broadcast_address))


def trim_zeros(data: Column, left: bool = True) -> Column:
    """Binary without zero bytes at one end."""
    return F.unhex(F.regexp_replace(F.hex(data), "^(00)+" if left else "(00)+$", ""))
