"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target over
size. Its fraction is rounded by the pivotal method, weighted by size: two
fractional documents trade words, one way or the other at random so that each
keeps its expectation, until one of them is integral. A source's words stay the
same in every trade, so the mix misses its target by less than one document.

Rows are dealt to buckets of (source, hash), each a stream that leaves one
fractional document at most; the leftovers meet again in fan_in times fewer
buckets, level by level, until one bucket of a source remains. All draws come from hashes of
rows, so the layout of the table plays no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, mix, sliced, sums, text_buffer

WEIGHTS = (3, 1, 2)
#: A source's rows for each bucket, and buckets that meet in one of the next level.
BUCKET_ROWS, FAN_IN = 4096, 32
#: Up to so many sources, their targets are broadcast.
BROADCAST_SOURCES = 100_000

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def count_words(column: pa.Array) -> np.ndarray:
    """The number of [^\\x20\\x09-\\x0D]+ in each text; null has none."""
    offsets, data = text_buffer(column)
    low, high = offsets[0], offsets[-1]
    word = ~IS_SPACE[data[low:high]]
    start = word.copy()
    start[1:] &= ~word[:-1]
    offsets = offsets - low
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[begins] = word[begins]  # a text begins anew
    return sums(start, offsets)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, th, source, size): th is the hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(count_words(b.column(3)))], ["doc_id", "th", "source", "size"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "source", "text").mapInArrow(run, "doc_id long, th long, source string, size long")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n_rows, source_size, target) by filling sources to one level of target / weight, capped at most * size."""
    per = rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = total_share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("full", F.col("level") > F.col("cap") / F.col("w"))
    per = per.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
    return per.select("source", "n_rows", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


COLUMNS = "doc_id long, th long, source string, size long, source_size long, target double, base long, mass double, draw long, buckets long, bucket long"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def round_stream(last: bool, seed: int):
    """A pass over rows sorted by (source, bucket): trade mass; one row of a bucket may stay fractional unless `last`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None  # the fractional row (size, mass, the rest) of the bucket at hand

        def settled(row: list, mass: float, done: list) -> None:
            row[7] = float(mass)
            done.append(row)

        def close(done: list) -> None:
            nonlocal held
            if held is not None:
                size, mass, row = held
                if last:
                    u = (int(mix(np.array([row[8] ^ seed ^ 0x5BD1E995], np.int64).view(np.uint64))[0]) >> 11) / 2**53
                    mass = float(size) if u * size < mass else 0.0
                settled(row, mass, done)
                held = None

        for b in batches:
            done: list = []
            keys = mix((b.column(8).to_numpy() ^ np.int64(seed)).view(np.uint64)) >> np.uint64(11)
            for row, key in zip(zip(*(c.to_pylist() for c in b.columns), strict=True), keys.tolist(), strict=True):
                row = list(row)
                size, mass, here = row[3], row[7], (row[2], row[10])
                if here != at:
                    close(done)
                    at = here
                if mass <= 0 or mass >= size:
                    settled(row, 0.0 if mass <= 0 else size, done)
                elif held is None:
                    held = (size, mass, row)
                else:
                    other, theirs, their_row = held
                    gain, give = min(other - theirs, mass), min(theirs, size - mass)  # to the held row; from it
                    if key / 2**53 * (gain + give) < give:
                        theirs, mass = (other if gain == other - theirs else theirs + gain), (0.0 if gain == mass else mass - gain)
                    else:
                        theirs, mass = (0.0 if give == theirs else theirs - give), (size if give == size - mass else mass + give)
                    held = None
                    for s, m, r in ((other, theirs, their_row), (size, mass, row)):
                        if 0 < m < s:
                            held = (s, m, r)
                        else:
                            settled(r, m, done)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), b.schema.types, strict=True)], NAMES)
        done = []
        close(done)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), TYPES, strict=True)], NAMES)

    return run


TYPES = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in COLUMNS.split(", ")]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0, seed: int = 20240229) -> DataFrame:
    """(doc_id, th, source, size, source_size, target, copies, taken) for each row of docs; th is xxhash64 of the text.

    docs: doc_id, source, text; other columns are ignored. A size is the words of a
    text, 0 for null. Sources in code point order, null last, have the weights in
    turn. Rows without words have no copies. Null doc_ids are allowed; repeated rows
    are rows of their own, ordered by hash. An empty table gives none. No copies
    exceed `most` rounded up.
    """
    rows = checkpointed(sized(docs))
    goal = checkpointed(targets(rows, weights, total_share, most))
    limits = goal.agg(F.count("*"), F.coalesce(F.max("n_rows"), F.lit(0))).first()
    goal = (F.broadcast(goal) if limits[0] <= BROADCAST_SOURCES else goal).withColumnRenamed("source", "source_")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.xxhash64("doc_id", "th", F.lit(seed))
    buckets = F.ceil(F.col("n_rows") / BUCKET_ROWS)
    level = rows.join(goal, F.col("source").eqNullSafe(F.col("source_"))).withColumn("copies", copies).select(
        "doc_id", "th", "source", "size", "source_size", "target",
        F.floor("copies").alias("base"),
        ((F.col("copies") - F.floor("copies")) * F.col("size")).alias("mass"),
        draw.alias("draw"),
        buckets.alias("buckets"),
        F.pmod(draw, buckets).alias("bucket"),
    )
    done, n, depth = None, -(-limits[1] // BUCKET_ROWS), 0
    while True:
        last = n <= 1
        ordered = level.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "draw", "doc_id", "th")
        level = checkpointed(ordered.mapInArrow(round_stream(last, seed + depth), COLUMNS))
        integral = (F.col("mass") <= 0) | (F.col("mass") >= F.col("size"))
        done = level.where(integral) if done is None else done.unionByName(level.where(integral))
        if last:
            break
        level = level.where(~integral).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        n, depth = -(-n // FAN_IN), depth + 1
    whole = F.col("base") + F.when((F.col("size") > 0) & (F.col("mass") >= F.col("size")), 1).otherwise(0)
    taken = F.when(F.col("size") > 0, whole).otherwise(0).cast("long")
    return done.select("doc_id", "th", "source", "size", "source_size", "target", taken.alias("copies"), (taken * F.col("size")).alias("taken"))
