from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import toxicity as tox

BIG = "/root/testdata/sf0.1"


def test_gradients():
    r = np.random.default_rng(0)
    net = tox.Network.fresh({b"a": 1}, np.zeros(2))
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    g, mask = r.standard_normal((3, 5, 2, tox.GATES)), (np.arange(5) < np.array([5, 3, 1])[:, None]).astype(float)
    w = r.standard_normal(3)
    keep = []
    net.forward(g, mask, keep)
    grad, dg = net.backward(w, mask, keep)
    loss = lambda: float(net.forward(g, mask) @ w)
    for k in ("u", "a", "v", "o", "c"):
        for i in [tuple(r.integers(0, s) for s in net.p[k].shape) for _ in range(4)]:
            old = net.p[k][i]
            net.p[k][i] = old + 1e-2
            up = loss()
            net.p[k][i] = old - 1e-2
            down = loss()
            net.p[k][i] = old
            assert abs((up - down) / 2e-2 - grad[k][i]) < 2e-3 * max(1, abs(grad[k][i])), k
    for i in [(0, 2, 0, 1), (1, 2, 1, 9), (0, 0, 0, 20), (2, 0, 1, 3)]:
        old = g[i]
        g[i] = old + 1e-2
        up = loss()
        g[i] = old - 1e-2
        down = loss()
        g[i] = old
        assert abs((up - down) / 2e-2 - dg[i]) < 2e-3


def test_windows_cover_all_words():
    n = np.array([0, 1, 32, 33, 48, 49, 1000])
    owner, start, length = tox.windows(n)
    first = np.cumsum(n) - n
    for i, k in enumerate(n):
        covered = set()
        for s, m in zip(start[owner == i], length[owner == i], strict=True):
            assert first[i] <= s and s + m <= first[i] + k and m > 0
            covered |= set(range(s, s + m))
        assert len(covered) == k


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in tox.score_toxicity(docs, tox.train(docs, labels)).collect()}
    y = {r.doc_id: r.toxic for r in labels.collect()}
    held = [d for d in y if crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out for d in held)
    truth, said, score = (np.array(x) for x in ([y[d] for d in held], [got[d].predicted for d in held], [got[d].score for d in held]))
    order = score.argsort().argsort()
    auc = (order[truth == 1].sum() - (truth == 1).sum() * ((truth == 1).sum() - 1) / 2) / ((truth == 1).sum() * (truth == 0).sum())
    print("AUC", auc, "precision", (truth * said).sum() / said.sum(), "recall", (truth * said).sum() / truth.sum())
    assert auc > 0.9 and (truth == said).mean() > 0.9


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (4, 0, 1), (9, 0, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    net = tox.train(odd_docs, labels)
    got = tox.score_toxicity(odd_docs.withColumnRenamed("n_chars", "score"), net).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert tox.score_toxicity(no_docs, tox.train(no_docs, labels.limit(0))).count() == 0


def plain_score(net, text):
    """The score of a text, a window and a step at a time."""
    words = text.split()
    best = []
    starts = range(0, max(1, len(words) - tox.WINDOW + tox.STRIDE), tox.STRIDE)
    for start in starts if words else ():
        part = words[start : start + tox.WINDOW]
        x = [np.concatenate([net.p["word"][net.vocabulary.get(p, 0)], mean]) for p, mean in ((w.lower().strip(tox.EDGES), char_mean(net, w.lower().strip(tox.EDGES))) for w in part)]
        states = []
        for d in (0, 1):
            h, found = np.zeros(tox.HIDDEN), []
            for v in x if d == 0 else x[::-1]:
                g, rec = v @ net.p["w"][d] + net.p["b"][d], h @ net.p["u"][d]
                k = tox.HIDDEN
                z, r = 1 / (1 + np.exp(-(g[:k] + rec[:k]))), 1 / (1 + np.exp(-(g[k : 2 * k] + rec[k : 2 * k])))
                h = z * h + (1 - z) * np.tanh(g[2 * k :] + r * rec[2 * k :])
                found.append(h)
            states.append(found if d == 0 else found[::-1])
        out = np.array([np.concatenate(pair) for pair in zip(*states, strict=True)])
        s = np.tanh(out @ net.p["a"]) @ net.p["v"]
        alpha = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        best.append(float((alpha[:, None] * out).sum(0) @ net.p["o"] + net.p["c"][0]))
    return 1 / (1 + np.exp(-max(best, default=float(net.p["c"][0]))))


def char_mean(net, word):
    marked = b"^" + word + b"$"
    grams = [(a * 7919 + b * 104729 + c * 1299709) * 2654435761 % 2**32 >> 21 for a, b, c in zip(marked, marked[1:], marked[2:])]
    return np.mean([net.p["char"][g] for g in grams], 0) if grams else np.zeros(tox.CHAR_DIM)


def test_score_against_a_plain_network():
    r = np.random.default_rng(3)
    vocabulary = [b"alpha", b"beta", b"gamma", b"delta", b"awful", b"nice"]
    net = tox.Network.fresh({w: i for i, w in enumerate(vocabulary, 1)}, r.standard_normal(7))
    texts = [b" ".join(vocabulary[i] if i < 6 else b"Other%d!," % i for i in r.integers(0, 40, n)) for n in (0, 1, 2, 31, 32, 33, 48, 49, 64, 65, 200)] + ["É été, ÇA 日本".encode(), b"...", b" \n "]
    got = tox.Scorer(net).score(texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)


def test_the_sample_depends_on_rows_not_layout(spark):
    docs = spark.createDataFrame([(i % 90, f"text {i % 300} here", 1) for i in range(900)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(90)], "doc_id long, toxic int, quality int")
    a, b = (tox.train(d, lab, rows=10) for d, lab in ((docs, labels), (docs.repartition(7, "text"), labels.orderBy(F.rand(1)))))
    assert a.vocabulary == b.vocabulary and all(np.array_equal(a.p[k], b.p[k]) for k in a.p)
