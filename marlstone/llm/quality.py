"""Quality rules by document and by host.

Documents are measured once (numpy over Arrow buffers); failures are counted by
host, each host's rate is shrunk toward a beta prior fitted to all hosts, and hosts
whose shrunk rate is high are rejected with all their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpointed, shingles, sliced, sums, text_buffer, text_bytes

#: A host is rejected if its shrunk failure rate is at least this.
HOST_RATE = 0.5
#: Up to so many rejected hosts are broadcast.
BROADCAST_HOSTS = 100_000
WINDOW = 8

SYMBOL = np.zeros(256, np.uint8)
SYMBOL[list(b"#*$%&|<>")] = 1
#: First bytes of code points outside [\x20\x09-\x0D].
LETTER = np.array([b & 0xC0 != 0x80 and b not in b" \t\n\x0b\x0c\r" for b in range(256)], np.uint8)

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more."""
    if len(hashes) <= window:
        return 0
    h = shingles(hashes, window)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, source) and MEASURES of every row."""
    names = ["doc_id", "source", *(m.split()[0] for m in MEASURES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches):
            offsets, data = text_buffer(b.column(2))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            per = []
            for text in text_bytes(b.column(2)):
                words = text.split()
                lines = [x for x in text.split(b"\n") if x.strip()]  # bytes.strip() takes away just [\x20\x09-\x0D]
                per.append((len(words), len(lines) - len(set(lines)), repeated_words(hashes.of(words)), text.count(b"\n") + 1))
            n_words, dup, repeat, n_lines = np.array(per, np.int64).reshape(-1, 4).T
            made = (n_words, sums(LETTER[data], offsets), sums(SYMBOL[data], offsets), dup, repeat, n_lines)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, made)], names)

    return docs.select("doc_id", "source", "text").mapInArrow(run, f"doc_id long, source string, {MEASURES}")


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def any_failed():
    """What counts against a host: the base rules, many symbols, many repeated lines, odd word lengths."""
    return base_failed() | (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) | ~F.col("word_chars").between(2 * F.col("n_words"), 15 * F.col("n_words"))


def rejected_hosts(measured: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """(source, host_rate) of hosts whose failure rate, shrunk by the beta prior of all hosts, is at least rate.

    The prior is fitted by moments, hosts weighing as their rows do: its mean m is the
    rate of all rows; its strength is 1 / r - 1, r being the part of the hosts' spread
    that binomial noise doesn't explain,
    (sum n (p - m)^2 - (k - 1) m (1 - m)) / (m (1 - m) (N - sum n^2 / N - (k - 1))), for k hosts of N rows.
    """
    hosts = measured.groupBy("source").agg(F.count("*").alias("n"), F.sum(any_failed().cast("long")).alias("failed"))
    n, failed = F.col("n").cast("double"), F.col("failed").cast("double")
    total, bad, k, squares, own = hosts.agg(F.sum(n), F.sum(failed), F.count("*"), F.sum(n * n), F.sum(failed * failed / n)).first()
    mean = min(max((bad or 0.0) / (total or 1.0), 1e-6), 1 - 1e-6)
    noise = mean * (1 - mean)
    spare = noise * ((total or 0.0) - (squares or 0.0) / (total or 1.0) - (k - 1))
    beyond = ((own or 0.0) - 2 * mean * (bad or 0.0) + mean * mean * (total or 0.0) - noise * (k - 1)) / spare if spare > 0 else 0.0
    strength = 1 / min(max(beyond, 1e-6), 1 / 3) - 1
    shrunk = (F.col("failed") + strength * mean) / (F.col("n") + strength)
    return hosts.select("source", shrunk.alias("host_rate")).where(F.col("host_rate") >= rate)


def judge(docs: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """(doc_id, source, MEASURES, base_failed, host_rejected, kept) of every row.

    Words are [^\\x20\\x09-\\x0D]+. Null text has none and fails. Rows of null source
    are one host. Null doc_ids and repeated rows are judged like any others, one
    result each. Other columns are ignored. An empty table gives none. Rejected hosts
    are broadcast if there are at most BROADCAST_HOSTS; beyond that the join is by
    host, and adaptive execution splits a host of many rows.
    """
    measured = checkpointed(measure(docs))
    bad = checkpointed(rejected_hosts(measured, rate))
    few = bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    bad = bad.select(F.col("source").alias("host"), F.lit(True).alias("bad"))
    joined = measured.join(F.broadcast(bad) if few else bad, F.col("source").eqNullSafe(F.col("host")), "left")
    out = joined.withColumn("base_failed", base_failed()).withColumn("host_rejected", F.coalesce("bad", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("host", "bad")
