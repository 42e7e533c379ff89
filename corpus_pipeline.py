"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the docs of the next. All but the last return the columns
of docs, whatever their names (but no maps, which can't be ordered). A document is
told by its doc_id and the hash of its text; a null in any column, an empty text,
repeated rows or an empty table are allowed throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import langid, line_dedup, mixing, near_dup, packing
from marlstone.llm.common import checkpointed, set_aside
from marlstone.llm.queries import tokenizer_path

#: Documents of a language less likely than this are rejected.
LEAST_SCORE = 0.5
#: Up to so many documents that rows repeat, their keys are broadcast.
BROADCAST_KEYS = 1_000_000


def key_of(doc_id: Column, th: Column, *more: Column) -> list[Column]:
    """Columns that equal rows of a document share, none null: k0, k1, ..."""
    parts = [F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), th]
    for c in more:
        parts += [F.coalesce(c, F.lit("")), c.isNull()]
    return [c.alias(f"k{i}") for i, c in enumerate(parts)]


def matched(docs: DataFrame, keys: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Rows of docs, as struct `row`, joined to keys (k0, ..., n_rows, ...): those alone under their key, and those that share it.

    The first can't be skewed. The second, however many rows repeat one document,
    stay where they are if the documents repeated are few enough to be broadcast;
    else adaptive execution splits them.
    """
    names = [c for c in keys.columns if c.startswith("k")]
    rows = docs.select(*key_of(F.col("doc_id"), F.xxhash64("text"), *map(F.col, more)), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    shared = keys.where("n_rows > 1")
    few = shared.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(keys.where("n_rows = 1"), names), rows.join(F.broadcast(shared) if few else shared, names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or less than LEAST_SCORE likely to be in the language predicted, go; so do those that look like none."""
    held, back = set_aside(docs, "held_out", "lang_pred", "score")
    known = langid.predict_languages(held)
    return back(known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that a larger doc_id holds and n_chars follows; documents stay."""
    held, back = set_aside(docs, "n_lines", "n_dropped", "keep_runs", "kept_text")
    out, lost = line_dedup.dedup_lines(held), F.col("n_dropped") > 0
    out = out.withColumn("text", F.when(lost, F.col("kept_text")).otherwise(F.col("text")))
    return back(out.withColumn("n_chars", F.when(lost, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays; of rows that repeat a doc_id and text, the smallest in the order of all columns."""
    kept = near_dup.near_duplicates(docs).where("kept").select(*key_of(F.col("doc_id"), F.col("th")))
    kept = checkpointed(kept.groupBy(*kept.columns).agg(F.count("*").alias("n_rows")))
    alone, shared = matched(docs, kept)
    one = shared.groupBy(*[c for c in kept.columns if c != "n_rows"]).agg(F.min("row").alias("row"))
    return alone.select("row.*").unionByName(one.select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document; those it doesn't take go. Rows without words stay as they are.

    The copies of rows that repeat a document in a source are dealt to them evenly,
    the first in the order of all columns having one more.
    """
    plan = mixing.mix_sources(docs).withColumn("n", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")))
    plan = plan.select(*key_of(F.col("doc_id"), F.col("th"), F.col("source")), "n")
    names = [c for c in plan.columns if c != "n"]
    plan = checkpointed(plan.groupBy(*names).agg(F.count("*").alias("n_rows"), F.sum("n").alias("total")).where(F.col("total") > 0))
    alone, shared = matched(docs, plan, "source")
    # equal rows are counted before they meet; what is left of a document are rows that differ in other columns
    alike = shared.groupBy(*names, "n_rows", "total", "row").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy(*names).orderBy("row")) - F.col("m")
    spare = F.least(F.greatest(F.col("total") % F.col("n_rows") - before, F.lit(0)), F.col("m"))
    dealt = alike.select("row", (F.floor(F.col("total") / F.col("n_rows")) * F.col("m") + spare).alias("times"))
    every = alone.select("row", F.col("total").alias("times")).unionByName(dealt)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long")))
    return every.where("times > 0").select("row", copies.alias("copy")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; see packing.pack."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language ID", language_id), ("line dedup", dedup_lines), ("near-dedup", dedup_near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written to the checkpoint folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID, signatures and rounding aren't SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None
