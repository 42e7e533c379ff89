"""Toxicity by a bidirectional GRU with attention pooling, trained and run in numpy.

A word enters as the embedding of the word itself (a vocabulary from the training
rows) and the mean embedding of its hashed character trigrams. Every window of a
text is read in both directions, its states are pooled by attention, and a text's
score is that of its most toxic window. In training, too, a text stands for
its highest window. All windows of all texts are scored; neighbours overlap by half.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_bytes

#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 32, 16
VOCABULARY, TRIGRAMS, WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8192, 2048, 12, 6, 8, 8
#: A bounded sample is learned from: rows of each label, their longest text.
ROWS, CHARS = 750, 20_000
EPOCHS, BATCH, RATE = 5, 75, 0.02
EDGES = b".,;:!?\"'()[]|*#%&$<>-"
GATES = 3 * HIDDEN


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, length) of the windows over texts of n_words words, end to end; a text without words has none."""
    count = np.where(n_words > 0, 1 + np.maximum(0, -(-(n_words - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(n_words)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = np.cumsum(n_words) - n_words
    start = nth * STRIDE
    return owner, first[owner] + start, np.minimum(WINDOW, n_words[owner] - start)


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, words they belong to) of the character trigrams of ^word$."""
    joined = np.frombuffer(b"".join(b"^" + w + b"$ " for w in words), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) + 3 for w in words])
    if len(joined) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (joined[:-2] * np.uint32(7919) + joined[1:-1] * np.uint32(104729) + joined[2:] * np.uint32(1299709)) * np.uint32(2654435761)
    inside = owner[:-2] == owner[2:]
    inside &= joined[2:] != ord(" ")
    return (h[inside] >> np.uint32(21)).astype(np.int64), owner[:-2][inside]


class Network:
    """Parameters p and a vocabulary: word -> row of the word embeddings, 0 for others."""

    def __init__(self, vocabulary: dict[bytes, int], p: dict[str, np.ndarray]):
        self.vocabulary, self.p = vocabulary, p

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], odds: np.ndarray, seed: int = 1) -> Network:
        """odds: log odds of each vocabulary row, where the first dimension of its embedding starts."""
        r, d = np.random.default_rng(seed), WORD_DIM + CHAR_DIM
        p = {
            "word": 0.1 * r.standard_normal((len(odds), WORD_DIM)), "char": 0.1 * r.standard_normal((TRIGRAMS, CHAR_DIM)),
            "w": r.standard_normal((2, d, GATES)) / np.sqrt(d), "b": np.zeros((2, GATES)), "u": r.standard_normal((2, HIDDEN, GATES)) / np.sqrt(HIDDEN),
            "a": r.standard_normal((2 * HIDDEN, ATTENTION)) / np.sqrt(2 * HIDDEN), "v": 0.1 * r.standard_normal(ATTENTION), "o": 0.3 * r.standard_normal(2 * HIDDEN), "c": np.array([-1.0]),
        }
        p["word"][:, 0] = odds
        return cls(vocabulary, {k: x.astype(np.float32) for k, x in p.items()})

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """The input vector of each (distinct) word."""
        plain = [w.lower().strip(EDGES) for w in words]
        ids = np.array([self.vocabulary.get(w, 0) for w in plain], np.int64)
        grams, owner = trigrams(plain)
        n = np.maximum(1, np.bincount(owner, minlength=len(words)))[:, None].astype(np.float32)
        mean = np.stack([np.bincount(owner, self.p["char"][grams, i], len(words)) for i in range(CHAR_DIM)], 1).astype(np.float32) / n
        return np.concatenate([self.p["word"][ids], mean], 1), (ids, grams, owner, n)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What the inputs add to the gates of both directions, (words, 2, GATES)."""
        return np.stack([x @ self.p["w"][d] + self.p["b"][d] for d in (0, 1)], 1)

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows; g: (windows, WINDOW, 2, GATES), mask: (windows, WINDOW). keep collects what backward needs."""
        n, t = mask.shape
        out = np.empty((n, t, 2 * HIDDEN), np.float32)
        for d in (0, 1):
            h = np.zeros((n, HIDDEN), np.float32)
            for j in range(t) if d == 0 else range(t - 1, -1, -1):
                rec = h @ self.p["u"][d]
                zr = sigmoid(g[:, j, d, : 2 * HIDDEN] + rec[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(g[:, j, d, 2 * HIDDEN :] + r * rec[:, 2 * HIDDEN :])
                m = mask[:, j, None] * (1 - z)
                if keep is not None:
                    keep.append((d, j, h, z, r, new, rec[:, 2 * HIDDEN :], m))
                h = h + m * (new - h)
                out[:, j, d * HIDDEN : (d + 1) * HIDDEN] = h
        act = np.tanh(out @ self.p["a"])
        s = np.where(mask > 0, act @ self.p["v"], -1e9)
        alpha = np.exp(s - s.max(1, keepdims=True))
        alpha /= alpha.sum(1, keepdims=True)
        pooled = (alpha[:, :, None] * out).sum(1)
        if keep is not None:
            keep.append((out, act, alpha, pooled))
        return pooled @ self.p["o"] + self.p["c"]

    def backward(self, dlogit: np.ndarray, mask: np.ndarray, keep: list) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters above the inputs, and of g."""
        p, (out, act, alpha, pooled) = self.p, keep.pop()
        grad = {"o": dlogit @ pooled, "c": np.array([dlogit.sum()])}
        dpool = dlogit[:, None] * p["o"]
        ds = (out * dpool[:, None, :]).sum(2)
        ds = alpha * (ds - (alpha * ds).sum(1, keepdims=True))
        dact = ds[:, :, None] * p["v"] * (1 - act**2)
        grad["v"] = (ds[:, :, None] * act).sum((0, 1))
        grad["a"] = np.einsum("btk,bta->ka", out, dact)
        dout = alpha[:, :, None] * dpool[:, None, :] + dact @ p["a"].T
        n, t = mask.shape
        dg, grad["u"] = np.zeros((n, t, 2, GATES), np.float32), np.zeros_like(p["u"])
        dh = {0: np.zeros((n, HIDDEN), np.float32), 1: np.zeros((n, HIDDEN), np.float32)}
        for d, j, h, z, r, new, rec_n, m in reversed(keep):
            dhj = dh[d] + dout[:, j, d * HIDDEN : (d + 1) * HIDDEN]
            dnew = dhj * m * (1 - new**2)
            dz = -dhj * (new - h) * mask[:, j, None] * z * (1 - z)
            dr = dnew * rec_n * r * (1 - r)
            dg[:, j, d] = np.concatenate([dz, dr, dnew], 1)
            drec = np.concatenate([dz, dr, dnew * r], 1)
            grad["u"][d] += h.T @ drec
            dh[d] = dhj * (1 - m) + drec @ p["u"][d].T
        return grad, dg


class Scorer:
    """A network with the gate inputs of words it has met."""

    def __init__(self, net: Network, limit: int = 60_000):
        self.net, self.limit = net, limit
        self.ids: dict[bytes, int] = {}
        self.table = np.zeros((0, 2, GATES), np.float32)

    def words(self, texts: list[list[bytes]]) -> np.ndarray:
        """Rows of the table for all words of the texts, end to end; words not met are added first."""
        if len(self.ids) > self.limit:
            self.ids, self.table = {}, np.zeros((0, 2, GATES), np.float32)
        new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in self.ids]
        if new:
            self.ids |= zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True)
            self.table = np.concatenate([self.table, self.net.gates(self.net.inputs(new)[0])])
        return np.fromiter((self.ids[w] for t in texts for w in t), np.int64)

    def logits(self, rows: np.ndarray, start: np.ndarray, length: np.ndarray, step: int = 1024) -> np.ndarray:
        """Logits of windows of rows."""
        out, at = np.empty(len(start), np.float32), np.arange(WINDOW)
        for i in range(0, len(start), step):
            mask = at < length[i : i + step, None]
            index = np.where(mask, start[i : i + step, None] + at, 0)
            out[i : i + step] = self.net.forward(self.table[rows[index]], mask.astype(np.float32))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """A score from 0 to 1 for each text; that of a text without words is the network's for no input."""
        split = [t.split() for t in texts]
        owner, start, length = windows(np.array([len(w) for w in split], np.int64))
        best = np.full(len(texts), -np.inf)
        if len(owner):
            np.maximum.at(best, owner, self.logits(self.words(split), start, length))
        best[np.isinf(best)] = float(self.net.p["c"][0])
        return sigmoid(np.clip(best, -30, 30))


def fit(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network trained on (text, label). With one label alone, or none, it says so for all texts."""
    y = np.array([label for _, label in rows], np.float32)
    split = [t.split() for t, _ in rows]
    plain = [{w.lower().strip(EDGES) for w in t} for t in split]
    seen, toxic = Counter(w for t in plain for w in t), Counter(w for t, label in zip(plain, y, strict=True) if label for w in t)
    kept = [w for w, n in seen.most_common(VOCABULARY) if n >= 3]
    n1, n0 = max(1.0, float(y.sum())), max(1.0, float(len(y) - y.sum()))
    odds = np.array([0.0] + [np.log((toxic[w] + 0.5) / (n1 + 1)) - np.log((seen[w] - toxic[w] + 0.5) / (n0 + 1)) for w in kept])
    net = Network.fresh({w: i for i, w in enumerate(kept, 1)}, np.clip(odds, -3, 3) / 2, seed)
    net.p["o"][:] = np.abs(net.p["o"]) if not len(rows) else net.p["o"]
    net.p["c"][:] = np.log(n1 / n0) if 0 < y.sum() < len(y) else 4.0 * (2 * bool(y.sum()) - 1)
    random, moments, step = np.random.default_rng(seed), {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}, 0
    if not 0 < y.sum() < len(y):
        net.p["o"][:] = 0
        return net
    for epoch in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = [i for i in order[at : at + BATCH].tolist() if split[i]]
            if not pick:
                continue
            scorer, texts = Scorer(net), [split[i] for i in pick]
            ids = scorer.words(texts)
            owner, start, length = windows(np.array([len(t) for t in texts], np.int64))
            logit = scorer.logits(ids, start, length)
            top = np.array([np.flatnonzero(owner == i)[logit[owner == i].argmax()] for i in range(len(texts))])
            mask = np.arange(WINDOW) < length[top, None]
            index = ids[np.where(mask, start[top, None] + np.arange(WINDOW), 0)]
            words = list(scorer.ids)
            x, (word_ids, grams, gram_owner, n) = net.inputs(words)
            keep: list = []
            z = net.forward(net.gates(x)[index], mask.astype(np.float32), keep)
            grad, dg = net.backward(((sigmoid(z) - y[pick]) / len(pick)).astype(np.float32), mask.astype(np.float32), keep)
            dgates = np.zeros((len(words), 2, GATES), np.float32)
            np.add.at(dgates, index, dg)
            grad["w"], grad["b"] = np.stack([x.T @ dgates[:, d] for d in (0, 1)]), dgates.sum(0)
            dx = sum(dgates[:, d] @ net.p["w"][d].T for d in (0, 1))
            grad["word"], grad["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(grad["word"], word_ids, dx[:, :WORD_DIM])
            np.add.at(grad["char"], grams, (dx[:, WORD_DIM:] / n)[gram_owner])
            step += 1
            for k, (m, v) in moments.items():
                m += 0.1 * (grad[k] - m)
                v += 0.02 * (grad[k] ** 2 - v)
                net.p[k] -= (RATE * (1 - 0.8 * epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, rows: int = ROWS, chars: int = CHARS) -> Network:
    """Learn from texts whose label is known, but not from rows whose crc32(doc_id as text) modulo mod is rest.

    A bounded sample is read: about `rows` ids of each label, picked by hash (so that the
    layout of the tables plays no part), with texts of up to `chars`. A doc_id with
    several labels has the highest; one with several texts gives each.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % mod != rest))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_003)) / 1_000_003
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("y") == label, min(1.0, rows / n)).otherwise(share)
    order = [F.xxhash64("doc_id", F.lit("toxicity")), F.col("doc_id")]
    picked = known.where(drawn < share).orderBy(*order).limit(4 * rows)
    texts = docs.select("doc_id", "text").where(F.char_length("text") <= chars).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "text"])
    found = texts.orderBy(*order, "text").limit(4 * rows).collect()
    return fit([(t.encode(), int(y > 0)) for _, t, y in sorted((r.doc_id, r.text, r.y) for r in found)])


def score_toxicity(docs: DataFrame, net: Network, threshold: float = 0.3, mod: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null or blank text has the score of no input. A null doc_id is not held out.
    Repeated rows have the same score each. Other columns are ignored. An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((net.vocabulary, net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(*shared.value))
        for b in sliced(batches, 256):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.score(text_bytes(b.column(1))), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
