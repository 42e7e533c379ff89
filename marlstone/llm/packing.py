"""Cost-balanced sequence packing.

Each task packs its own rows: documents become token ids, whole sequences are cut
off long ones, and what remains waits in a window. The cost of a piece of n tokens
is linear * n + quadratic * n * n. In a window the pieces go, longest first, to the
sequence of lowest cost that has room; if none has room for a whole piece, it is cut
at the room of the sequence of lowest cost. A window opens as many sequences as its
tokens fill, so all are full; tokens that are left move to the next window, and at
the end of a task fill sequences of power-of-two lengths, which need no padding.
Nothing is shuffled; memory is one window and one document. Whole sequences cut off
long documents are full by themselves, so they take no part in the balancing.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import sliced, text_bytes

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


#: ASCII, and letters that are their own NFC form and turn to lower case one by one (U+0130 gives two characters).
PLAIN_RUN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+")


class ChunkIds(dict):
    """Ids (little-endian uint32 bytes) of a run of UTF-8 between ASCII white space.

    The tokenizers used drop white space and never join across it, so the ids of a
    text are those of its runs. The first `limit` runs are remembered. If the
    tokenizer is NFC, lower case, a split by a pattern and byte-level BPE, runs of
    ASCII and Latin letters are split by that pattern and given to its model piece
    by piece, which is four times as fast as its whole chain; the rest, and runs with
    a special token's string, go through the chain.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.pieces: dict[str, bytes] = {}
        self.pattern, self.model, self.mapped = self.split_rule(), self.tokenizer.model, {}
        self.special = re.compile("|".join(map(re.escape, (t.content for t in self.tokenizer.get_added_tokens_decoder().values()))) or "(?!)")

    def split_rule(self):
        """The compiled pattern, if the tokenizer has the form that the short way stands for."""
        import regex

        form = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (form["normalizer"] or {}).get("normalizers", [])]
        first, *rest = (form["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        bytewise = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        kept = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"]
        if steps != ["NFC", "Replace", "Lowercase"] or not bytewise or not kept or form["post_processor"]:
            return None
        return regex.compile(first["pattern"]["Regex"])

    def piece(self, word: str) -> bytes:
        """Ids of a piece that the pattern found."""
        found = self.pieces.get(word)
        if found is None:
            found = array("I", [t.id for t in self.model.tokenize(word if word.isascii() else "".join(map(self.byte_chars, word)))]).tobytes()
            if len(word) <= 64 and len(self.pieces) < self.limit:
                self.pieces[word] = found
        return found

    def byte_chars(self, char: str) -> str:
        """The characters that stand for the bytes of one."""
        if char not in self.mapped:
            from tokenizers.pre_tokenizers import ByteLevel

            self.mapped[char] = "".join(p for p, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(char))
        return self.mapped[char]

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode()
        if self.pattern and PLAIN_RUN.fullmatch(text) and not self.special.search(text):
            text = text.lower()
            ids = self.piece(text) if text.isalpha() else b"".join(map(self.piece, self.pattern.findall(text)))
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(run) <= 64 and len(self) < self.limit:
            self[run] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def assign(lengths: np.ndarray, room: np.ndarray, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """Pieces (item, start in it, length, bin, offset in the bin), and the (item, start) that found no room."""
    room, used, cost = room.astype(np.int64), np.zeros(len(room), np.int64), np.zeros(len(room))
    placed, left = [], []
    for item in np.argsort(-lengths, kind="stable").tolist():
        start, n = 0, int(lengths[item])
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
                if not fits.any():
                    left.append((item, start))
                    break
            to = int(np.argmin(np.where(fits, cost, np.inf)))
            k = min(n, int(room[to]))
            placed.append((item, start, k, to, int(used[to])))
            room[to] -= k
            used[to] += k
            cost[to] += linear * k + quadratic * k * k
            start, n = start + k, n - k
    return placed, left


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, eos: int = 2, window_tokens: int = 1 << 21, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """Pieces of all documents, SCHEMA.

    docs: doc_id, text; other columns are ignored. A document's ids are those of its
    text with eos after them; null or empty text is eos alone. Null doc_ids, ties
    and repeated rows are packed like any others. capacity must be a power of two.
    sequence_id is unique over all tasks; a retried task returns the same. An empty
    table gives none. tokenizer_path must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, tail = ChunkIds(tokenizer_path), int(eos).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        window: list[tuple[int | None, int, int, bytes]] = []  # doc_id, start, doc_tokens, ids
        waiting = 0

        def drain() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], FIELDS)
                out.clear()

        def settle(last: bool) -> None:
            nonlocal window, waiting, sequence
            lengths = np.array([len(w[3]) // 4 for w in window], np.int64)
            total = int(lengths.sum())
            room = [capacity] * (total // capacity) + (powers(total % capacity) if last else [])
            placed, left = assign(lengths, np.array(room, np.int64), linear, quadratic)
            for item, start, n, to, offset in placed:
                doc, began, tokens, ids = window[item]
                out.append((doc, began + start, n, crc32(ids[4 * start : 4 * (start + n)]), tokens, sequence + to, offset))
            sequence += len(room)
            window = [(window[i][0], window[i][1] + s, window[i][2], window[i][3][4 * s :]) for i, s in left]
            waiting = sum(len(w[3]) // 4 for w in window)

        for batch in sliced(batches):
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                ids = chunks.of(text) + tail
                tokens = len(ids) // 4
                whole = tokens - tokens % capacity
                for start in range(0, whole, capacity):
                    out.append((doc, start, capacity, crc32(ids[4 * start : 4 * (start + capacity)]), tokens, sequence, 0))
                    sequence += 1
                if whole < tokens:
                    window.append((doc, whole, tokens, ids[4 * whole :]))
                    waiting += tokens - whole
                if waiting >= window_tokens:
                    settle(False)
                if len(out) >= 20_000:
                    yield from drain()
        settle(True)
        yield from drain()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
