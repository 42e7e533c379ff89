import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np

from test_near_dup import chain, check

import corpus_pipeline
from marlstone.llm import common, near_dup
from marlstone.llm.components import UnionFind

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(60))


def test_one_doc_id_with_different_texts(spark):
    rows = [(5, text(1)), (5, text(2)), (2, text(2) + " end"), (None, text(1) + " end"), (None, text(3)), (8, text(4)), (8, text(4) + " end"), (1, text(5)), (1, text(6)), (1, text(7)), (9, text(6) + " end")]
    for some in (rows, rows[::-1], rows[3:] + rows[:3]):
        check(spark.createDataFrame(some, "doc_id long, text string").repartition(3))
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], DOCS)
    left = sorted((r.doc_id, r.text) for r in corpus_pipeline.dedup_near(spark, docs, "").collect() if r.doc_id is not None)
    assert (5, text(1)) in left and (5, text(2)) not in left and (2, text(2) + " end") in left and (9, text(6) + " end") not in left


def test_repeated_doc_ids_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 2000)
    texts = chain(1, 60, 3) + chain(2, 60, 4) + chain(3, 10, 1) * 2
    random.Random(4).shuffle(texts)
    check(spark.createDataFrame([(i % 50 if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5))


def test_ids_of_any_size(spark):
    base = " ".join(f"word{i}" for i in range(60))
    ids = [2**62 + 5, 2**62 + 7, 2**63 - 1, -(2**63), -1, 0, 2**62]
    rows = [(d, base + " end" * (i % 3)) for i, d in enumerate(ids)] + [(2**63 - 2, "something else than all of the others"), (2**62 + 9, text(7))]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_many_small_classes_in_one_block_take_memory_of_their_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30_000, 6)).astype(np.uint64) for _ in range(15_000)]
    sets[17] = sets[14_000].copy()
    parts = list(range(len(sets)))
    tracemalloc.start()
    found = near_dup.links_between(parts, sets, parts, [True] * len(sets), 75)
    assert tracemalloc.get_traced_memory()[1] < 40e6  # as bits, classes by shingles, they would take 56 MB
    tracemalloc.stop()
    by_word = defaultdict(list)
    for i, s in enumerate(sets):
        for w in s.tolist():
            by_word[w].append(i)
    want = set()
    for i, s in enumerate(sets):
        for j, n in Counter(j for w in s.tolist() for j in by_word[w] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                want.add((j, i))
    assert {(min(p), max(p)) for p in found} <= want and (17, 14_000) in {(min(p), max(p)) for p in found}
    reach = UnionFind()
    for a, b in found:
        reach.union(a, b)
    assert all(reach.find(a) == reach.find(b) for a, b in want)


def test_pairs_at_the_border_are_found(spark):
    """600 pairs of similarity 0.75 to 0.78, each in a bucket of its own: the banding loses about 5e-6 of them."""
    r = random.Random(9)
    rows = []
    for i in range(600):
        words = [f"v{r.randrange(10**7)}" for _ in range(204)]  # 200 shingles
        cut = 25 + i % 4  # shingles that differ at the end: (200 - cut) / (200 + cut)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 204 - cut] + [f"u{r.randrange(10**7)}" for _ in range(cut)]))]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_empty_texts_and_columns_that_clash(spark):
    df = spark.createDataFrame([(i, ["", None, "  ", text(1)][i % 4], "x", "y", i) for i in range(400)], "doc_id long, text string, node string, key string, th long")
    check(df)
