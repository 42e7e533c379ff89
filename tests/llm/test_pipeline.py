from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_langid import by_force as languages_by_force
from test_line_dedup import brute as lines_by_force
from test_mixing import goals
from test_near_dup import brute as classes_by_force

from marlstone.llm import mixing


@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
def test_stages_against_brute_force(request, spark, table, tmp_path):
    df = request.getfixturevalue(table)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near-dedup", "mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, "")
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = df.collect(), out.collect()
        if name != "packing":
            assert out.columns == df.columns
        pairs = lambda rows: Counter((r.doc_id, r.text) for r in rows)
        if name == "language ID":
            predict = languages_by_force(df)
            assert pairs(after) == pairs([r for r in before if predict(r.text)[0] != "und" and predict(r.text)[1] >= 0.5])
        elif name == "line dedup":
            assert Counter((r.doc_id, r.text or "") for r in after) == Counter((d, t) for d, _, _, t in lines_by_force([(r.doc_id, r.text) for r in before]))
        elif name == "near-dedup":
            kept = {(d, n) for d, n, _, stays in classes_by_force([(r.doc_id, r.text) for r in before]) if stays}
            assert {r.doc_id for r in after} == {d for d, _ in kept} and len(after) == len({(r.doc_id, r.text) for r in after})
        elif name == "mixing":
            size = lambda t: int(mixing.count_words(__import__("pyarrow").array([t], "string"))[0])
            have, take = defaultdict(int), defaultdict(int)
            for r in before:
                have[r.source] += size(r.text)
            for r in after:
                take[r.source] += size(r.text)
            for s, want in goals(have).items():
                assert abs(take[s] - want) <= max((size(r.text) for r in before if r.source == s), default=0)
            assert max(pairs(after).values(), default=0) <= 2 * max(pairs(before).values(), default=1)
        else:
            starts = Counter((r.doc_id, r.doc_tokens) for r in after if r.start == 0)
            assert sum(starts.values()) == len(before)
            assert sum(r.length for r in after) == sum(n * k for (_, n), k in starts.items())
        df = out


def test_run(spark):
    from marlstone.llm.queries import queries

    out = queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where(F.col("length") <= 0).count() == 0


def words(n, seed):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def test_repeated_rows_and_columns_that_clash(spark):
    """Rows that repeat a document, in all columns or in some, and columns named like helpers of the stages."""
    cols = "doc_id long, text string, lang string, source string, n_chars long, k0 string, row int, score string, n_lines int, __id int, th string"
    hot = words(30, 1)
    rows = [(7, hot, "en", "a", 5, "x", 1, "s", 1, 1, "t")] * 40 + [(7, hot, "en", "a", 6, None, None, None, None, None, None)] * 3 + [(7, hot, "fr", "b", 5, "x", 1, "s", 1, 1, "t")] * 2
    rows += [(None, words(25, i + 1000), "en", "a", 5, "y", i, "s", 0, i, "") for i in range(20)] + [(i, words(20 + i, i), None, None, None, "z", i, None, i, None, "t") for i in range(100, 120)]
    df = spark.createDataFrame(rows, cols).repartition(5)
    names = df.columns
    once = corpus_pipeline.dedup_near(spark, df, "")
    assert once.columns == names and Counter(r.doc_id for r in once.collect()) == {7: 1, None: 20, **{i: 1 for i in range(100, 120)}}
    assert [(r.source, r.n_chars) for r in once.where("doc_id = 7").collect()] == [("a", 5)]  # the smallest row
    again = corpus_pipeline.dedup_near(spark, df.repartition(3, "n_chars"), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, once.collect()))  # the layout plays no part
    mixed = corpus_pipeline.mix(spark, df, "")
    taken = mixing.mix_sources(df).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()
    assert mixed.columns == names
    have = Counter((r.doc_id, r.source) for r in mixed.collect())
    assert all(have[r.doc_id, r.source] == r.n for r in taken)
    for stage in (corpus_pipeline.language_id, corpus_pipeline.dedup_lines):
        out = stage(spark, df, "")
        assert out.columns == names and out.count() <= len(rows)
    assert corpus_pipeline.dedup_lines(spark, df, "").where("k0 = 'y'").select("n_lines", "__id", "th").distinct().count() == 20


def test_copies_of_alike_rows_are_dealt_evenly(spark, monkeypatch):
    df = spark.createDataFrame([(1, words(10, 1), "en", "a", 5)] * 7 + [(1, words(10, 1), "en", "a", 6)] * 5 + [(2, words(50, 2), "en", "b", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {r.doc_id: r.n for r in mixing.mix_sources(df).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    for keys in (1_000_000, 0):
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", keys)
        got = Counter((r.doc_id, r.n_chars) for r in corpus_pipeline.mix(spark, df, "").collect())
        least, more = divmod(want[1], 12)
        assert got[1, 5] == 7 * least + min(7, more) and got[1, 6] == 5 * least + max(0, more - 7) and got[2, 7] == want[2]
