"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy.

Counts are made in executors, a language at a time, from a bounded sample; the
matrix of log probabilities is broadcast. A batch of texts becomes sparse counts
(text, gram, n), which are multiplied with the rows of the matrix in slices of
bounded size, so memory depends neither on the length of a text nor on the number
of languages.

The posterior of naive Bayes is all but 0 or 1 on whole texts, since neighbouring
n-grams say the same thing. The score is therefore a softmax of the mean log
probability of an n-gram, times a scale of least log loss on labelled rows that
the counts leave out. One more class, of uniform n-grams, stands for "none of
these": it lowers the score of text unlike any language learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, sliced

#: Orders of n-grams, bits of their hashes, and what is added to each count.
ORDERS, BITS, SMOOTH = (1, 2, 3), 15, 0.5
#: A bounded sample is learned from: rows of a language, and their longest text. Every fifth of them calibrates.
ROWS, CHARS, CALIBRATION = 400, 50_000, 5
#: More languages than this are an error (ISO 639-3 has some 7,900); none is left out.
MOST_LANGUAGES = 10_000
#: Code points of a group of texts, and entries of the matrix that are gathered at once.
SLICE, GATHER = 1 << 18, 1 << 21
#: A short text is uncertain: n-grams that say nothing and are added to each text.
EMPTY_GRAMS = 30
#: Scales to choose from, and the one taken if there is nothing to calibrate on.
SCALES, SCALE = np.geomspace(0.5, 32, 37), 3.0
#: The part of a label that is spread over all classes, so that separable rows don't call for an endless scale.
SMOOTH_LABEL = 0.01


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def grams(chars: np.ndarray, n: int) -> np.ndarray:
    """A bucket for each n-gram of chars."""
    h = np.full(max(0, len(chars) - n + 1), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ chars[i : len(chars) - n + 1 + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
    return h >> np.uint32(32 - BITS)


def gram_counts(text: str) -> np.ndarray:
    chars = code_points(text)
    return sum(np.bincount(grams(chars, n), minlength=1 << BITS) for n in ORDERS)


def spread(x: np.ndarray, scale: float) -> np.ndarray:
    """Softmax of scale * x by row."""
    p = np.exp(scale * (x - x.max(1, keepdims=True)))
    return p / p.sum(1, keepdims=True)


class Bayes:
    """log P(gram | language) as a matrix of 2**BITS rows, log P(language), the languages, and the scale of the score."""

    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray, scale: float = SCALE):
        self.langs, self.logp, self.prior, self.scale = langs, logp, prior, scale

    @classmethod
    def of_counts(cls, langs: list[str], counts: list[np.ndarray], docs: list[int]) -> Bayes:
        logp = np.empty((1 << BITS, len(langs)), np.float32)
        for k, c in enumerate(counts):
            logp[:, k] = np.log((c + SMOOTH) / (c.sum() + SMOOTH * (1 << BITS)))
        return cls(langs, logp, np.log(np.maximum(docs, 1) / max(1.0, np.sum(docs))))

    @classmethod
    def learn(cls, rows: list[tuple[str, str]]) -> Bayes:
        langs = sorted({lang for lang, _ in rows})
        texts = [[t for lang, t in rows if lang == name] for name in langs]
        return cls.of_counts(langs, [sum(map(gram_counts, t)) for t in texts], [len(t) for t in texts])

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log joint probability of each text with each language, n-grams of each text)."""
        total, n_grams = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
        step = max(1, GATHER // max(1, len(self.langs)))
        keys: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal keys, size
            if keys:
                found, n = np.unique(np.concatenate(keys), return_counts=True)
                owner, column = found >> BITS, found & ((1 << BITS) - 1)
                for at in range(0, len(found), step):
                    mine = owner[at : at + step]
                    first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else []
                    part = self.logp[column[at : at + step]] * n[at : at + step, None].astype(np.float64)
                    total[mine[first]] += np.add.reduceat(part, first, axis=0)
            keys, size = [], 0

        for i, text in enumerate(texts):
            chars = code_points(text)
            for at in range(0, len(chars), SLICE):
                for n in ORDERS:
                    g = grams(chars[at : at + SLICE + n - 1], n).astype(np.int64)
                    n_grams[i] += len(g)
                    keys.append(g | i << BITS)
                size += min(SLICE, len(chars) - at)
                if size >= SLICE:
                    flush()
        flush()
        return total, n_grams

    def means(self, texts: list[str]) -> np.ndarray:
        """Mean log probability of an n-gram in each language, and, last, among uniform n-grams."""
        x, n = self.sums(texts)
        return np.concatenate([x, -np.log(2.0) * BITS * n[:, None]], 1) / (n + EMPTY_GRAMS)[:, None]

    def losses(self, rows: list[tuple[str, str]]) -> np.ndarray:
        """Summed log loss of labelled rows for each of SCALES, with smoothed labels; languages not learned count as none."""
        if not rows:
            return np.zeros(len(SCALES))
        x, at = self.means([t for _, t in rows]), np.array([self.langs.index(lang) if lang in self.langs else len(self.langs) for lang, _ in rows])
        low = x - x.max(1, keepdims=True)
        wanted = (1 - SMOOTH_LABEL) * low[np.arange(len(at)), at] + SMOOTH_LABEL * low.mean(1)
        return np.array([(np.log(np.exp(s * low).sum(1)) - s * wanted).sum() for s in SCALES])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        known = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        x = self.means([t if k else "" for t, k in zip(texts, known, strict=True)])
        best = x[:, :-1].argmax(1)
        score = spread(x, self.scale)[np.arange(len(x)), best]
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), known, strict=True)], [s if k else 0.0 for s, k in zip(score.tolist(), known, strict=True)]


def sample(labelled: DataFrame, rows: int, chars: int) -> DataFrame:
    """(lang, text, nth): of each language the `rows` rows of smallest hash with texts of up to `chars`; nth counts them."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= chars)).select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n_lang")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages in lang")
    share = labelled.sparkSession.createDataFrame([(r[0], min(1.0, 2 * rows / r[1] + 1e-4)) for r in sizes], "of string, share double")
    usable = usable.withColumn("h", F.xxhash64("doc_id", F.lit("langid")))
    near = usable.join(F.broadcast(share), F.col("lang") == F.col("of")).where(F.pmod("h", F.lit(1_000_003)) < F.col("share") * 1_000_003)
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_003)), "h", F.xxhash64("text"), "text")
    return near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rows).select("lang", "text", "nth")


def train(labelled: DataFrame, rows: int = ROWS, chars: int = CHARS) -> Bayes:
    """Learn from (doc_id, text, lang): at most `rows` rows of each language with texts of up to `chars`, those of smallest hash.

    Of rows that repeat, each counts. The model has 2**BITS entries a language, and
    the driver holds two such tables; a language's sample is counted in one task.
    """
    drawn = checkpointed(sample(labelled, rows, chars))

    def count(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BITS, np.int64)
        for text in table.column("text"):
            total += gram_counts(text.as_py())
        return pa.table({"lang": table.column("lang").slice(0, 1), "n": [table.num_rows], "counts": pa.array([total.astype("<i4").tobytes()], pa.binary())})

    calibrates = F.col("nth") % CALIBRATION == 0
    learned = sorted(drawn.where(~calibrates).groupBy("lang").applyInArrow(count, "lang string, n long, counts binary").collect())
    model = Bayes.of_counts([r[0] for r in learned], [np.frombuffer(r[2], "<i4") for r in learned], [r[1] for r in learned])
    shared = labelled.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.prior))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes, total = Bayes(*shared.value), np.zeros(len(SCALES))
        for b in sliced(batches):
            total += bayes.losses(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(SCALES))), pa.array(total)], ["scale", "loss"])

    if learned:
        loss = drawn.where(calibrates).select("lang", "text").mapInArrow(judge, "scale long, loss double").groupBy("scale").agg(F.sum("loss").alias("loss"))
        found = min(((round(r["loss"], 9), r["scale"]) for r in loss.collect()), default=(0.0, 0))
        model.scale = float(SCALES[found[1]]) if found[0] else SCALE
    return model


def identify(docs: DataFrame, model: Bayes) -> DataFrame:
    """docs with lang_pred and score; see predict_languages."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.prior, model.scale))
    at = docs.columns.index("text")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes = Bayes(*shared.value)
        for b in sliced(batches):
            langs, scores = bayes.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, held_out_mod: int = 5, held_out_rest: int = 0) -> DataFrame:
    """docs with held_out, lang_pred and score.

    Learned from the text and lang of rows whose crc32(doc_id as text) modulo
    held_out_mod is not held_out_rest; a null doc_id is neither learned from nor
    held out. lang_pred is the likeliest language; score is its calibrated share,
    lower for short text and for text unlike all languages. Text that is null, empty
    or without a letter is `und` with score 0; so is all text if there is nothing to
    learn from. Repeated rows get the same result each; of tied languages the first
    by name is taken. Columns of docs with these names are replaced. An empty table
    gives none.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % held_out_mod
    model = train(docs.where(rest != held_out_rest))
    return identify(docs.withColumn("held_out", F.coalesce(rest == held_out_rest, F.lit(False))), model)
