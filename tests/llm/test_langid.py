import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from marlstone.llm import langid

BIG = "/root/testdata/sf0.01"


def bucket(chars: str) -> int:
    """The bucket of an n-gram, in plain integers."""
    h = len(chars) * 0x9E3779B1 % 2**32
    for c in chars:
        h = (h ^ ord(c)) * 0x85EBCA6B % 2**32
        h ^= h >> 13
    return h >> 32 - langid.BITS


def grams_of(text: str) -> Counter:
    low = text.lower()
    return Counter(bucket(low[i : i + n]) for n in (1, 2, 3) for i in range(len(low) - n + 1))


def plain_bayes(rows: list[tuple[str, str]], scale: float):
    """A function text -> (language, score), by the textbook."""
    langs = sorted({lang for lang, _ in rows})
    counts = {k: sum((grams_of(t) for lang, t in rows if lang == k), Counter()) for k in langs}
    logp = {k: {g: math.log((n + 0.5) / (sum(counts[k].values()) + 0.5 * 2**15)) for g, n in counts[k].items()} for k in langs}
    rare = {k: math.log(0.5 / (sum(counts[k].values()) + 0.5 * 2**15)) for k in langs}

    def predict(text):
        found = grams_of(text)
        n = sum(found.values())
        x = [math.log(sum(lang == k for lang, _ in rows) / len(rows)) + sum(c * logp[k].get(g, rare[k]) for g, c in found.items()) for k in langs]
        mean = [v / (n + 30) for v in [*x, -n * 15 * math.log(2)]]
        p = [math.exp(scale * (v - max(mean))) for v in mean]
        best = max(range(len(langs)), key=lambda i: x[i])
        return langs[best], p[best] / sum(p)

    return predict


def by_force(df):
    """(language, score) of a text by plain Bayes; the sample and the scale are those of the operator."""
    usable = df.where("crc32(cast(doc_id as string)) % 5 != 0")
    predict = plain_bayes([(r.lang, r.text) for r in langid.sample(usable, 400, langid.CHARS).collect() if r.nth % 5], langid.train(usable).scale)
    return lambda text: predict(text) if text and any(c.isalpha() for c in text) else ("und", 0.0)


def test_training_and_prediction_against_plain_bayes(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    table = rows.collect()
    learned = [r for r in table if r.lang and r.text and len(r.text) <= langid.CHARS and crc32(str(r.doc_id).encode()) % 5]
    drawn = langid.sample(rows.where("crc32(cast(doc_id as string)) % 5 != 0"), 400, langid.CHARS).collect()
    assert Counter((r.lang, r.text) for r in drawn) == Counter((r.lang, r.text) for r in learned)  # fewer than 400 of a language: all of them
    got, predict = {r.doc_id: r for r in langid.predict_languages(rows).collect()}, by_force(rows)
    for r in table:
        lang, score = predict(r.text)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-4


def test_held_out_accuracy_and_loss(spark):
    df = spark.read.parquet(f"{BIG}/documents.parquet")
    got = {(r.doc_id): r for r in langid.predict_languages(df.select("doc_id", "text", "lang")).collect()}
    rows = df.collect()
    held = [r for r in rows if crc32(str(r.doc_id).encode()) % 5 == 0 and r.lang]
    assert all(got[r.doc_id].held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = np.array([got[r.doc_id].lang_pred == r.lang for r in held])
    assert right.mean() >= 0.98, right.mean()
    score = np.array([got[r.doc_id].score for r in held])
    loss = -np.log(np.clip(np.where(right, score, 1 - score), 1e-9, 1)).mean()
    assert loss < 0.05 and len(np.unique(score.round(9))) > len(score) / 2  # the score isn't saturated


def test_text_of_no_language_scores_low():
    model = langid.Bayes.learn([("en", "the quick dog and the fox went over the hill " * 1000), ("de", "über die Straße und der Hund ging hinauf " * 1000)])
    langs, scores = model.predict(["the dog and the hill were over the quick fox", "日本語のテキストはここにあります、そして続きます" * 4, "1234 !!", None, "z"])
    assert langs[0] == "en" and langs[2:4] == ["und", "und"]
    assert scores[0] > 0.9 and scores[1] < 0.01 and scores[2:4] == [0.0, 0.0] and scores[4] < 0.7


def test_sample_is_exact_and_bounded(spark):
    rows = [(i % 50, f"text {i} of many", "en") for i in range(3000)] + [(i, "texte", "fr") for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pick = lambda x: sorted((r.lang, r.nth, r.text) for r in langid.sample(x, 100, 1000).collect())
    got = pick(df)
    assert Counter(r[0] for r in got) == {"en": 100, "fr": 7}
    assert got == pick(df.repartition(7, "text"))  # the layout plays no part


def test_many_languages_take_little_memory():
    import tracemalloc

    logp = np.random.default_rng(1).standard_normal((1 << langid.BITS, 500)).astype(np.float32)
    model = langid.Bayes([f"l{i}" for i in range(500)], logp, np.zeros(500))
    text = "".join(chr(97 + i * i % 26) + chr(200 + i * 7 % 900) for i in range(300_000))
    tracemalloc.start()
    x, n = model.sums([text])
    assert tracemalloc.get_traced_memory()[1] < 250e6  # a row of the matrix for each n-gram would take 3.6 GB
    tracemalloc.stop()
    assert np.allclose(x[0, 7], sum(logp[langid.grams(langid.code_points(text), k), 7].sum(dtype=float) for k in (1, 2, 3)))


def test_odd_rows(odd_docs, no_docs):
    got = langid.predict_languages(odd_docs.withColumnRenamed("n_chars", "score")).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (1, 2, 7, 8))
    assert all(by[d].lang_pred in ("en", "de", "fr", "ja") for d in (3, 4, 5, 6, 9, None)) and by[None].held_out is False
    assert langid.predict_languages(no_docs).count() == 0


@pytest.mark.parametrize("size", [10, 300, 2000])
def test_slices_add_up(monkeypatch, size):
    texts = ["the quick brown fox", "", "ä", "über die Straße " * 60, "le chat et la souris"]
    model = langid.Bayes.learn([("en", "the quick dog and the fox " * 9), ("de", "über die Straße und der Hund " * 9)])
    whole, n = model.sums(texts)
    for text, row, k in zip(texts, whole, n, strict=True):
        want = model.prior + sum(model.logp[langid.grams(langid.code_points(text), n)].sum(0, dtype=float) for n in langid.ORDERS)
        assert np.allclose(row, want) and k == sum(max(0, len(text) - i) for i in range(3))
    monkeypatch.setattr(langid, "SLICE", size)
    monkeypatch.setattr(langid, "GATHER", size)
    assert np.allclose(model.sums(texts)[0], whole)
