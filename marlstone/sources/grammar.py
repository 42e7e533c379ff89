"""Operation traces as text: read, order, parse, and cut into block segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPERATION = r"OPType: (\w+),(?: key: ([0-9a-fA-F]*), size: (\d+))?(?: prefix: ([0-9a-fA-F]*),)?(?:, value: [0-9a-fA-F]*, size: (\d+))?"
START, END = r"Processing block \(start\), ID: (\d+)", r"Processing block \(end\), ID: (\d+)"


def read_trace(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split_start, mid, line): file order is the order of the first three, with any number of splits."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line"))


def parse(lines: DataFrame) -> DataFrame:
    """lines with op_type, key, key_size, value_size, start_id and end_id; null where a line has none."""
    none = lambda c, i, kind: F.nullif(F.regexp_extract(c, OPERATION, i), F.lit("")).cast(kind)
    line = F.col("line")
    key = F.coalesce(F.nullif(F.regexp_extract(line, OPERATION, 2), F.lit("")), F.regexp_extract(line, OPERATION, 4))
    op = none(line, 1, "string")
    mark = lambda rule: F.nullif(F.regexp_extract(line, rule, 1), F.lit("")).cast("long")
    return lines.withColumns({"op_type": op, "key": F.when(op.isNotNull(), key), "key_size": none(line, 3, "int"), "value_size": none(line, 5, "int"), "start_id": mark(START), "end_id": mark(END)})


def segments(parsed: DataFrame) -> DataFrame:
    """parsed with segment_id (start markers so far) and block_id (id of the last one, null before any).

    Two passes: counts within each split, then what earlier splits of the file carry
    in, from a table of one row per split.
    """
    split = Window.partitionBy("file", "split_start")
    run = split.orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    inside = parsed.withColumns({"n_": F.count("start_id").over(run), "b_": F.last("start_id", ignorenulls=True).over(run)})
    per = parsed.groupBy("file", "split_start").agg(F.count("start_id").alias("k"), F.max_by("start_id", F.when(F.col("start_id").isNotNull(), F.col("mid"))).alias("b"))
    before = Window.partitionBy("file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("file", "split_start", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k"), F.last("b", ignorenulls=True).over(before).alias("b"))
    joined = inside.join(carry, ["file", "split_start"])
    return joined.withColumns({"segment_id": F.col("n_") + F.col("k"), "block_id": F.coalesce("b_", "b")}).drop("n_", "b_", "k", "b")


def mismatched_ends(segmented: DataFrame) -> DataFrame:
    """End markers whose id isn't that of the block they end."""
    return segmented.where(F.col("end_id").isNotNull() & ~F.col("end_id").eqNullSafe(F.col("block_id")))


def to_lines(op: Column, key: Column, value_size: Column) -> Column:
    """The message of an operation, as a trace has it after its time stamp."""
    size = (F.length(key) / 2).cast("int").cast("string")
    plain = F.concat(F.lit("OPType: "), op, F.lit(", key: "), key, F.lit(", size: "), size)
    return F.when(op == "NewIterator", F.concat(F.lit("OPType: NewIterator, prefix: "), key, F.lit(", start key: "))).when(op.isin("Put", "BatchPut"), F.concat(plain, F.lit(", value: 00, size: "), value_size.cast("string"))).otherwise(plain)


def rewrite_updates(line: Column, is_update: Column) -> Column:
    """The line with every operation name replaced by Update, where it is one."""
    return F.when(is_update, F.regexp_replace(line, r"OPType: \w+", "OPType: Update")).otherwise(line)
