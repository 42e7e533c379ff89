import re

import numpy as np
import pytest

from marlstone.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
def test_measures(request, table):
    df = request.getfixturevalue(table)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df.withColumnsRenamed({"n_chars": "kept", "lang": "N_WORDS"})).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=str)


def test_hosts(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good, f"good{i % 5}") for i in range(200)] + [(1000 + i, "too short", "bad") for i in range(60)] + [(2000, good, "bad"), (2001, good, None), (2002, "one", "tiny")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[2000].host_rejected and not got[2000].kept and not got[2000].base_failed
    assert all(got[i].kept for i in range(200)) and got[2001].kept
    assert not got[1000].kept and not got[2002].kept


def test_prior_leaves_noise_out(spark):
    """Hosts of one true rate: the spread of their rates is noise, so all are shrunk to the mean; hosts of two rates aren't."""
    rng = np.random.default_rng(8)
    measure = lambda rates: spark.createDataFrame([(f"h{i}", 5 if rng.random() < rate else 50, 0, 200, 0, 0, 1) for i, (rate, n) in enumerate(rates) for _ in range(n)], "source string, n_words long, n_repeat_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long")
    rate_of = lambda df: {r.source: r.host_rate for r in quality.rejected_hosts(df, 0.0).collect()}
    one = rate_of(measure([(0.3, 4)] * 300 + [(0.3, 400)] * 5))
    assert max(one.values()) - min(one.values()) < 0.15  # the raw rates of hosts of four rows run from 0 to 1
    two = rate_of(measure([(0.02, 50)] * 60 + [(0.95, 50)] * 10))
    assert sum(x > 0.8 for x in two.values()) == 10 and sum(x < 0.2 for x in two.values()) == 60
    assert rate_of(measure([(1.0, 30)])) and rate_of(measure([(1.0, 30)]).limit(0)) == {}
