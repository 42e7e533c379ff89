from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marlstone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
@pytest.mark.parametrize("window", [1 << 21, 9000])
def test_each_id_lies_in_one_piece(request, table, window):
    df = request.getfixturevalue(table)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    tok = Tokenizer.from_file(PATH)
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]
    pieces = packing.pack(df, PATH, window_tokens=window).collect()
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    want = defaultdict(list)
    for (d, _), x in zip(rows, ids, strict=True):
        want[d].append(x)
    for p in pieces:
        assert p.doc_tokens in [len(x) for x in want[p.doc_id]]
        assert any(len(x) == p.doc_tokens and crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in want[p.doc_id])
    spans, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        spans[p.doc_id, p.doc_tokens].append((p.start, p.length))
        seqs[p.sequence_id].append((p.offset, p.length))
    for (d, n), found in spans.items():
        times = sum(len(x) == n for x in want[d])
        assert sorted(s for s, _ in found).count(0) == times and sum(k for _, k in found) == n * times
    for found in seqs.values():
        end = 0
        for offset, n in sorted(found):
            assert offset == end and n > 0
            end += n
        assert end == 4096 or end & (end - 1) == 0  # no padding at all


def test_longest_first_to_the_lowest_cost():
    placed, left = packing.assign(np.array([5, 9, 4, 2]), np.array([10, 10]), 1.0, 1.0)
    assert placed == [(1, 0, 9, 0, 0), (0, 0, 5, 1, 0), (2, 0, 4, 1, 5), (3, 0, 1, 1, 9), (3, 1, 1, 0, 9)] and left == []


def test_special_strings_and_spaces():
    tok = Tokenizer.from_file(PATH)
    for text in ("a\u00a0b\u2003c", "x<|endoftext|>y z", "e\u0301 \u0301 A\u030a", "ΣΑΣ ΣΑΣ'S don't", "\u1680\u180e\ufeff q", "\x1c\x85a", "STRASSE İstanbul ıÍ ŉx ſ DON'T'RE you'll'd 'SX", "Ça,&&&42été+Ñ÷× ªº²", "a<|endoftext|>b C<|EndOfText|>d <|"):
        assert np.frombuffer(packing.ChunkIds(PATH).of(text.encode()), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_the_short_way_gives_the_ids_of_the_whole_chain():
    tok, chunks, r = Tokenizer.from_file(PATH), packing.ChunkIds(PATH), np.random.default_rng(5)
    assert chunks.pattern is not None
    chars = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x180), 0x301, 0x3C3, 0x4E2D, 0x1F600]] + ["'s", "'ll", "the", "ING"]
    for n in range(4000):
        run = "".join(chars[i] for i in r.integers(len(chars), size=1 + n % 12))
        assert np.frombuffer(chunks.of(run.encode()), "<u4").tolist() == tok.encode(run, add_special_tokens=False).ids, run


def test_another_tokenizer_goes_through_its_whole_chain():
    path = public_tokenizers.path("byte_bpe_50k.json")
    chunks = packing.ChunkIds(path)
    assert chunks.pattern is None
    assert np.frombuffer(chunks.of(b"Hello"), "<u4").tolist() == Tokenizer.from_file(path).encode("Hello", add_special_tokens=False).ids


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 5, None), (None, None, "y", 6, 7)], "doc_id long, text string, start string, length int, sequence_id int")
    got = sorted((r.doc_id or 0, r.start, r.doc_tokens) for r in packing.pack(df, PATH).collect())
    assert sorted({(d, n) for d, _, n in got}) == [(0, 1), (1, 4)]
