import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import line_dedup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(UP)
    rank = lambda d: -1 if d is None else d
    held = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(held.get(key(x), ())) < 3 or rank(d) == max(map(rank, held[key(x)]))]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
def test_against_brute_force(request, table):
    df = request.getfixturevalue(table)
    got = line_dedup.dedup_lines(df.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_common_keys_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 4)
    rows = [(i, f"this very common line is everywhere\nrow number {i % 7} of the small fixture") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_bitmap_and_clashing_columns(spark):
    line = "the same line in three documents"
    df = spark.createDataFrame([(i, f"a\n{line}\nb\n{line}", "x", 1) for i in range(3)], "doc_id long, text string, n_lines string, GONE int").withColumn("th", F.lit(1)).withColumn("pos", F.lit(2))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert [tuple(x) for x in out[0].keep_runs] == [(0, 1), (2, 1)] and [tuple(x) for x in out[2].keep_runs] == [(0, 4)]
    assert out[0].GONE == 1 and out[0].n_lines == 4 and out[1].kept_text == "a\nb" and hashlib.sha256(out[1].kept_text.encode()).hexdigest()
