"""Structured Streaming forms: tailing, counts, filters, polling, first writes, co-access pairs, sections, timers, meters, feeds."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.checkpoints import work_folder


def to_parquet(stream: DataFrame, folder: str, mode: str = "append", **trigger):
    """Write a stream under folder/rows, its progress under folder/progress, and return the query.

    A batch is a folder of its own that a repeated batch overwrites, so each row is
    there once; in complete mode every batch replaces the one before. Nothing goes
    through the driver.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else batch}")

    writer = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def written(stream: DataFrame, folder: str) -> DataFrame:
    """What to_parquet has written so far; stream gives the columns if that is nothing."""
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).parquet(f"{folder}/rows")


def drained(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run the stream over what is there now, and return what it wrote to folder (one of its own in the shared folder if not given)."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark, "stream")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    to_parquet(stream, folder, mode).awaitTermination()
    return written(stream, folder)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream with the schema it has now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder if name.endswith(".parquet") else path)


def tail(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Lines of a trace that is rolled into files of a folder, parsed, each file once: (file, line, op_type, key, ...).

    A file must be complete when it gets its name. Lines keep their order within a
    file; block segments are cut by grammar.segments over what has been written.
    """
    from marlstone.sources import grammar

    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    return grammar.parse(lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")))


def op_counts(trace: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts of (window, category, op_type); a window closes when the newest ts is `late` beyond it."""
    return trace.withWatermark("ts", late).groupBy(F.window("ts", width), "category", "op_type").agg(F.count("*").alias("n"))


def running_counts(trace: DataFrame) -> DataFrame:
    return trace.groupBy("category", "op_type").agg(F.count("*").alias("n"))


def first_writes(trace: DataFrame) -> DataFrame:
    """The first write of each key. State holds all keys: use the RocksDB state store at size."""
    return trace.where(F.col("op_type").isin("Put", "BatchPut")).dropDuplicates(["key"])


def new_heads(blocks: DataFrame) -> DataFrame:
    """Each header of a stream of blocks (block_number, hash, ...) once. State holds all hashes, 8 bytes of each in the key: use RocksDB at size."""
    return blocks.dropDuplicates(["block_number", "hash"])


def joined(streams: list[DataFrame]) -> DataFrame:
    """Several subscriptions as one."""
    return reduce(DataFrame.unionByName, streams)


def confirmed(rows: DataFrame, head: int, confirms: int = 256, section: int = 4096) -> DataFrame:
    """Rows of sections that lie confirms blocks or more below head, with their section."""
    done = (head + 1 - confirms) // section
    return rows.withColumn("section", F.floor(F.col("block_number") / section)).where(F.col("section") < done)


def signed_counts(logs: DataFrame, *by: str) -> DataFrame:
    """Live rows by group, where a removed row takes back one sent before. Batch, or a stream in complete mode."""
    return logs.groupBy(*by).agg(F.sum(F.when(F.col("removed"), -1).otherwise(1)).alias("n"))


def pairs(reads: DataFrame, distance: int) -> DataFrame:
    """(segment_id, seq, k1, k2): each read of (segment_id, seq, key) with the one distance + 1 before it in its segment.

    State holds the last distance + 1 keys of a segment. Rows of a segment must arrive
    in order from batch to batch; within a batch they are sorted.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("seq")
        keys = held + rows["key"].tolist()
        at = range(max(len(held), distance + 1), len(keys))
        state.update((keys[-(distance + 1) :],))
        two = [sorted((keys[i], keys[i - distance - 1])) for i in at]
        yield pd.DataFrame({"segment_id": key[0], "seq": [rows["seq"].iloc[i - len(held)] for i in at], "k1": [t[0] for t in two], "k2": [t[1] for t in two]})

    return reads.groupBy("segment_id").applyInPandasWithState(step, "segment_id long, seq long, k1 string, k2 string", "keys array<string>", "append", "NoTimeout")


class Poll:
    """Changes since the last call: each call to `changes` runs the stream over what has come since, from progress kept in a folder.

    A poll not asked for `ttl` seconds is forgotten: the next call is an error and the
    caller must start anew.
    """

    def __init__(self, stream: DataFrame, folder: str | None = None, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.stream, self.ttl, self.clock = stream, ttl, clock
        self.folder = folder or work_folder(stream.sparkSession, "poll")
        self.calls, self.asked = 0, clock()

    def changes(self) -> DataFrame:
        now = self.clock()
        if now - self.asked > self.ttl:
            raise KeyError("no such poll: it was not asked for too long")
        self.asked, self.calls = now, self.calls + 1
        out = f"{self.folder}/call={self.calls}"
        spark = self.stream.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        query = self.stream.writeStream.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
        query.option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(self.stream.schema).option("recursiveFileLookup", True).parquet(out)


class Sections:
    """The life of the sections of a chain as its head moves: which become known, which a reorg takes back.

    size blocks make a section; one is processed once `confirms` blocks lie on its
    last. A reorg to block h leaves the sections wholly up to h and takes back the rest, in
    children too. step gives (section, action) in order: reset, process and commit of a
    new section, rollback of one taken back (the newest first).
    """

    def __init__(self, size: int, confirms: int, known: int = 0):
        self.size, self.confirms, self.known = size, confirms, known

    def step(self, head: int, reorg: bool) -> list[tuple[int, str]]:
        if reorg:
            kept = min(self.known, (head + 1) // self.size)
            gone = [(s, "rollback") for s in range(self.known - 1, kept - 1, -1)]
            self.known = kept
            return gone
        done = max(self.known, (head + 1 - self.confirms) // self.size if head >= self.confirms else 0)
        new = [(s, action) for s in range(self.known, done) for action in ("reset", "process", "commit")]
        self.known = done
        return new


def section_events(heads: DataFrame, size: int = 4096, confirms: int = 256) -> DataFrame:
    """(chain, seq, nth, section, action) of a stream of heads (chain, seq, head, reorg); see Sections.

    Heads of a chain must arrive in order from batch to batch; within a batch they are
    sorted. State is one number a chain.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        life, out = Sections(size, confirms, state.get[0] if state.exists else 0), []
        rows = pd.concat(list(parts)).sort_values("seq")
        for seq, head, reorg in zip(rows["seq"].tolist(), rows["head"].tolist(), rows["reorg"].tolist(), strict=True):
            out += [(key[0], seq, n, s, a) for n, (s, a) in enumerate(life.step(head, reorg))]
        state.update((life.known,))
        yield pd.DataFrame(out, columns=["chain", "seq", "nth", "section", "action"]).astype({"seq": "int64", "nth": "int64", "section": "int64"})

    return heads.groupBy("chain").applyInPandasWithState(step, "chain string, seq long, nth long, section long, action string", "known long", "append", "NoTimeout")


def live_sections(events: DataFrame) -> DataFrame:
    """(chain, section) that are committed and not taken back, of section_events."""
    last = events.where(F.col("action").isin("commit", "rollback")).groupBy("chain", "section").agg(F.max_by("action", F.struct("seq", "nth")).alias("action"))
    return last.where("action = 'commit'").select("chain", "section")


def scrapes(times: DataFrame, group: str, value: str, width: str, late: str | None = None) -> DataFrame:
    """(start, group, n, low, high, mean) of each scrape of `width`, after which a timer starts empty; with `late`, a stream's scrape closes that long after its end."""
    timed = times.withWatermark("ts", late) if late else times
    v = F.col(value)
    out = timed.groupBy(F.window("ts", width), group).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"))
    return out.select(F.col("window.start").alias("start"), group, "n", "low", "high", "mean")


class Meter:
    """Events a second: a count, the mean since the start, and averages that a tick moves by 1 - exp(-seconds / 60 / minutes)."""

    MINUTES = (1, 5, 15)

    def __init__(self, seconds: float = 5.0, ticks: int = 0, count: int = 0, rates: tuple[float, ...] = (0.0, 0.0, 0.0)):
        self.seconds, self.ticks, self.count, self.rates = seconds, ticks, count, rates

    def tick(self, n: int) -> None:
        """The first tick sets the averages, each later one moves them."""
        now, first = n / self.seconds, self.ticks == 0
        self.rates = tuple(now if first else r + (1 - math.exp(-self.seconds / 60 / m)) * (now - r) for r, m in zip(self.rates, self.MINUTES, strict=True))
        self.ticks, self.count = self.ticks + 1, self.count + n

    @property
    def mean(self) -> float:
        return self.count / (self.ticks * self.seconds) if self.ticks else 0.0


def meters(ticks: DataFrame, seconds: float = 5.0) -> DataFrame:
    """(name, tick, n, mean, rate1, rate5, rate15) after each tick of a stream (name, tick, n).

    Ticks of a name must arrive in order from batch to batch; within a batch they are
    sorted. A tick that is missing counts as one without events if ticks are numbered on. State is five numbers a name.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, done, count, *rates = state.get if state.exists else (None, 0, 0, 0.0, 0.0, 0.0)
        meter, out = Meter(seconds, done, count, tuple(rates)), []
        rows = pd.concat(list(parts)).sort_values("tick")
        for tick, n in zip(rows["tick"].tolist(), rows["n"].tolist(), strict=True):
            for _ in range(0 if last is None else tick - last - 1):
                meter.tick(0)
            meter.tick(n)
            last = tick
            out.append((key[0], tick, n, meter.mean, *meter.rates))
        state.update((last, meter.ticks, meter.count, *meter.rates))
        yield pd.DataFrame(out, columns=["name", "tick", "n", "mean", "rate1", "rate5", "rate15"])

    schema = "name string, tick long, n long, mean double, rate1 double, rate5 double, rate15 double"
    return ticks.groupBy("name").applyInPandasWithState(step, schema, "last long, ticks long, count long, rate1 double, rate5 double, rate15 double", "append", "NoTimeout")


def feed(stream: DataFrame, subscribers: list[Callable[[DataFrame, int], None]], folder: str):
    """Send each batch to all subscribers; the next batch waits until every one has taken it, and a failure sends the batch to all again."""

    def send(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            for take in subscribers:
                take(rows, batch)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
