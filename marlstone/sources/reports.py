"""Text forms of counts, ranked distributions and pair frequencies, written and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = r"key: ([^;]*)-(\d+);([^;]*)-(\d+); Freq: (\d+); Blocks: (.*)"


def write_counts(counts: DataFrame, path: str) -> None:
    """`Category: c` and under it `  OPType: o, Count: n`; one partition per hash of category, each category whole."""
    rows = counts.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("op_type", "n"))).alias("ops"))
    body = F.array_join(F.transform("ops", lambda o: F.concat(F.lit("  OPType: "), o["op_type"], F.lit(", Count: "), o["n"].cast("string"))), "\n")
    rows.select(F.concat(F.lit("Category: "), "category", F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(category, op_type, n) of reports; lines without four fields are skipped. Each file is read whole."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "(?=Category: )")).alias("part"))
    rows = lines.select(F.trim(F.regexp_extract("part", r"^Category: ([^\n]*)", 1)).alias("category"), F.explode(F.split("part", "\n")).alias("line"))
    op, n = F.regexp_extract("line", r"OPType: (\w+), Count: (\d+)", 1), F.regexp_extract("line", r"OPType: (\w+), Count: (\d+)", 2)
    return rows.select("category", op.alias("op_type"), F.expr("try_cast(regexp_extract(line, 'Count: ([0-9]+)', 1) AS BIGINT)").alias("n")).where((F.col("op_type") != "") & n.isNotNull())


def write_distribution(ranked: DataFrame, path: str) -> None:
    """ID, Key, Count as TSV with a header, a folder for each of the other columns."""
    by = [c for c in ranked.columns if c not in ("id", "key", "n")]
    ranked.select(*by, F.col("id").alias("ID"), F.col("key").alias("Key"), F.col("n").alias("Count")).write.mode("overwrite").partitionBy(*by).csv(path, sep="\t", header=True)


def read_distribution(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="ID INT, Key STRING, Count BIGINT", mode="DROPMALFORMED")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """`key: k1-s1;k2-s2; Freq: n; Blocks: b1;b2`."""
    row = F.concat(F.lit("key: "), "k1", F.lit(";"), "k2", F.lit("; Freq: "), F.col("freq").cast("string"), F.lit("; Blocks: "), "blocks")
    pairs.select(row.alias("value")).write.mode("overwrite").text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(k1, k2, freq, blocks); a line of another form is an error."""
    part = lambda i: F.regexp_extract("value", PAIR, i)
    lines = spark.read.text(path).where(F.when(F.col("value").rlike(PAIR), True).otherwise(F.raise_error(F.concat(F.lit("not a pair: "), "value")).cast("boolean")))
    return lines.select(F.concat(part(1), F.lit("-"), part(2)).alias("k1"), F.concat(part(3), F.lit("-"), part(4)).alias("k2"), part(5).cast("long").alias("freq"), part(6).alias("blocks"))


def listed_files(spark: SparkSession, path: str) -> list[str]:
    """Paths listed one a line, each once."""
    return [r[0] for r in spark.read.text(path).where("value != ''").distinct().orderBy("value").collect()]


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of id -> record as rows (id, record as a map)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("id", "record"))


def write_distribution_counts(ranked: DataFrame, path: str) -> None:
    """ID and Count alone, without keys, as TSV with a header; a folder for each of the other columns. No rows, no files."""
    by = [c for c in ranked.columns if c not in ("id", "key", "n")]
    ranked.select(*by, F.col("id").alias("ID"), F.col("n").alias("Count")).write.mode("overwrite").partitionBy(*by).csv(path, sep="\t", header=True)


def write_size_report(kv: DataFrame, by: str, path: str, width: int) -> None:
    """The block of text of each type in path/summary, and histograms of keys, values and pairs as TSV in path/histograms/<by>/<part>.

    kv: by, key, value. Buckets of `width` bytes, ascending, those between a type's least and largest with zeros.
    """
    from marlstone.operators.access import size_histogram, size_summary

    k, v = F.octet_length("key"), F.octet_length("value")
    line = lambda text, c: F.concat(F.lit(f"  {text}: "), F.col(c).cast("string"))
    parts = [F.concat(F.lit("DataType: "), by), line("KV pair number", "n"), F.format_string("  Average KV size: %.2f", "avg_kv")]
    for name, one, title in (("keys", "key", "Key"), ("values", "value", "Value"), ("KVs", "kv", "KV pair")):
        parts += [line(f"Min size for {name}", f"min_{one}"), line(f"Max size for {name}", f"max_{one}"), F.lit(f"  {title} size distribution (Bucket width: {width} B):")]
    size_summary(kv, by).select(F.concat(F.concat_ws("\n", *parts), F.lit("\n")).alias("value")).write.mode("overwrite").text(f"{path}/summary")
    for one, size in (("key", k), ("value", v), ("kv", k + v)):
        found = size_histogram(kv, by, size, width).select(by, F.lit(one).alias("part"), F.col("bucket").alias("size"), F.col("n").alias("count"))
        ordered = found.repartition(by).sortWithinPartitions(by, "size")
        ordered.write.mode("overwrite" if one == "key" else "append").partitionBy(by, "part").csv(f"{path}/histograms", sep="\t", header=True)


def write_category_pairs(pairs: DataFrame, path: str) -> None:
    """Lines of pairs (cat1, cat2, k1, k2, freq, blocks) by falling freq, a folder for each pair of categories; and in path/totals the sums, falling, with a last line of them all."""
    row = F.concat(F.lit("key: "), "k1", F.lit(";"), "k2", F.lit("; Freq: "), F.col("freq").cast("string"), F.lit("; Blocks: "), "blocks")
    dealt = pairs.repartitionByRange("cat1", "cat2", F.desc("freq"), "k1", "k2").sortWithinPartitions("cat1", "cat2", F.desc("freq"), "k1", "k2")
    dealt.select("cat1", "cat2", row.alias("value")).write.mode("overwrite").partitionBy("cat1", "cat2").text(f"{path}/pairs")
    totals = pairs.groupingSets([["cat1", "cat2"], []], "cat1", "cat2").agg(F.sum("freq").alias("freq"), F.grouping("cat1").alias("all"))
    text = F.when(F.col("all") == 1, F.concat(F.lit("Total frequency: "), F.col("freq").cast("string"))).otherwise(F.concat_ws(": ", F.concat_ws(";", "cat1", "cat2"), F.col("freq").cast("string")))
    # a row for each pair of categories, some 2,800 at most
    totals.coalesce(1).sortWithinPartitions("all", F.desc("freq"), "cat1", "cat2").select(text.alias("value")).write.mode("overwrite").text(f"{path}/totals")


def read_category_totals(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(cat1, cat2, freq) of totals, and the last line's sum; a report without that line is an error."""
    lines = spark.read.text(path)
    total = lines.where(F.col("value").startswith("Total frequency: ")).select(F.regexp_extract("value", r"(\d+)$", 1).cast("long")).collect()
    if len(total) != 1:
        raise ValueError("not one total")
    part = lambda i: F.regexp_extract("value", r"^([^;]*);([^:]*): (\d+)$", i)
    return lines.where(~F.col("value").startswith("Total frequency: ")).select(part(1).alias("cat1"), part(2).alias("cat2"), part(3).cast("long").alias("freq")), total[0][0]


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, gib) of the files of an output, by listing alone; gib has two decimals."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    return found.withColumn("gib", F.round(F.col("bytes") / 1024**3, 2))


def read_nodes_typed(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of id -> {seq, record, score, firstResponse, lastResponse, lastCheck} as rows; entries within record stay JSON text."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("id", "node"))
    node = F.from_json("node", "seq long, record string, score int, firstResponse timestamp, lastResponse timestamp, lastCheck timestamp")
    out = text.select("id", node.alias("n"), F.get_json_object("node", "$.record").alias("record"))
    return out.select("id", F.col("n.seq").alias("seq"), "record", F.col("n.score").alias("score"), F.col("n.firstResponse").alias("first_response"), F.col("n.lastResponse").alias("last_response"), F.col("n.lastCheck").alias("last_check"))
