import re
from collections import Counter, defaultdict

import pytest

from marlstone.llm import mixing


def goals(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
@pytest.mark.parametrize("bucket", [4096, 2])
def test_targets_are_met(request, monkeypatch, table, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    df = request.getfixturevalue(table)
    rows = df.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    got = mixing.mix_sources(df).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((r.doc_id, size(r.text), r.source) for r in rows)
    want, taken = goals(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        assert not r.size or abs(r.copies - r.target / r.source_size) < 1 + 1e-9
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(size(r.text) for r in rows if r.source == s)


def test_layout_plays_no_part(docs):
    a, b = (sorted(map(tuple, mixing.mix_sources(df).collect())) for df in (docs, docs.repartition(7)))
    assert a == b


def test_expectations_are_kept(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), "s") for i in range(40)], "doc_id long, text string, source string")
    n = [mixing.mix_sources(df, weights=(1,), seed=k) for k in range(12)]
    total = Counter()
    for x in n:
        for r in x.collect():
            total[r.doc_id % 5] += r.copies
    assert all(abs(v / (8 * 12) - 1.5) < 0.25 for v in total.values())


def test_one_doc_id_with_different_texts_and_columns_that_clash(spark):
    rows = [(i % 20, " ".join(["w"] * (1 + i % 13)), "ab"[i % 2], "x", i, None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, th string, size long, target double")
    got = mixing.mix_sources(df).collect()
    assert len(got) == 200 and {r.source: r.source_size for r in got} == {s: sum(1 + i % 13 for i in range(200) if "ab"[i % 2] == s) for s in "ab"}
    assert all(r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] for r in got)
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) < 13
    again = sorted(map(str, mixing.mix_sources(df.repartition(5, "size")).collect()))
    assert again == sorted(map(str, got))
