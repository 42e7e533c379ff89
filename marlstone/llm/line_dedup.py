"""Line dedup across documents, in DataFrame operations only.

Each document's lines become rows (doc_id, text hash, position, 128-bit key
hash). The rows are range-partitioned by the key hash with a secondary sort by
document and position; one streaming pass over each key marks the lines beyond
the keeper. Keys so common that they would swamp one range are found first by
frequent-items sketches of bounded size, counted with map-side combining, and
their verdicts, at most HOT_SHARE, are broadcast. What leaves is a run-length bitmap of kept
lines per document, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, let, unused

SPACE = " \t\n\u000b\u000c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with over 1/HOT_SHARE of all lines takes the pre-aggregated way. A range holds such a share of them at least, unless there are more ranges.
HOT_SHARE = 20_000
#: So many counters has a sketch; its error is below 1/HOT_SHARE of the lines. Sketches of tasks are merged in so many groups, level by level.
SKETCH_ITEMS, MERGES = 1 << 16, (4096, 64, 1)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, pos, h1, h2) of every line whose key has at least min_chars code points."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def frequent(rows: DataFrame) -> DataFrame:
    """One row (n, s): the number of rows and a frequent-items sketch of h1, merged through a tree so that no task takes the sketches of all others."""
    sketches = rows.select("h1", F.spark_partition_id().alias("p")).groupBy((F.col("p") % MERGES[0]).alias("p")).agg(F.expr(f"approx_top_k_accumulate(h1, {SKETCH_ITEMS})").alias("s"), F.count("*").alias("n"))
    for groups in MERGES[1:]:
        sketches = sketches.groupBy((F.col("p") % groups).alias("p")).agg(F.expr(f"approx_top_k_combine(s, {SKETCH_ITEMS})").alias("s"), F.sum("n").alias("n"))
    return sketches


def dropped_lines(rows: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, th, pos) of lines that go: their key is in min_docs documents and theirs isn't the largest doc_id."""
    share = frequent(rows).select("n", F.expr(f"approx_top_k_estimate(s, {HOT_SHARE})").alias("top"))
    hot = share.select("n", F.inline("top")).where(F.col("count") * HOT_SHARE > F.greatest("n", F.lit(100 * HOT_SHARE))).select(F.col("item").alias("h1"))  # at most HOT_SHARE rows

    common = rows.join(F.broadcast(hot), "h1", "left_semi")
    verdict = common.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("_")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    gone_common = common.join(F.broadcast(verdict), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "th", "pos")

    rest = rows.join(F.broadcast(hot), "h1", "left_anti").repartitionByRange("h1")
    key = Window.partitionBy("h1", "h2")
    order = key.orderBy(F.col("doc_id").desc_nulls_last(), "pos", "th")
    other = F.row_number().over(order) == 1
    other = other | ~F.lag("doc_id").over(order).eqNullSafe(F.col("doc_id"))
    ranked = rest.withColumn("place", F.sum(other.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranked = ranked.withColumn("n_docs", F.max("place").over(key))  # spilled to disk where a key has many lines
    gone_rest = ranked.where((F.col("n_docs") >= min_docs) & (F.col("place") > 1)).select("doc_id", "th", "pos")
    return gone_common.unionByName(gone_rest)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents that lose lines: (doc_id, th, n_dropped, gone), gone being the sorted positions that go.

    A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z in
    lower case. Keys of at least min_chars code points found in at least min_docs
    documents keep their lines in the largest doc_id alone.

    Null or empty text is one empty line. A null doc_id counts as one document,
    smaller than any other. Rows that repeat a doc_id are one document for the
    count, and each is judged by itself (th, the hash of the text, tells them
    apart). Other columns of docs are not read. An empty table gives none.
    """
    gone = dropped_lines(checkpointed(line_rows(docs, min_chars)), min_docs)
    return gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone")).withColumn("n_dropped", F.size("gone"))


def runs(gone: Column, n_lines: Column) -> Column:
    """The run-length bitmap of kept lines: array of (start, len)."""
    def between(edges: Column) -> Column:
        run = lambda i: F.struct((F.get(edges, i) + 1).alias("start"), (F.get(edges, i + 1) - F.get(edges, i) - 1).alias("len"))
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(edges) - 2), run), lambda r: r["len"] > 0)

    return let(F.concat(F.array(F.lit(-1)), gone, F.array(n_lines.cast("int"))), between)


def apply_runs(text: Column, keep: Column) -> Column:
    """The kept lines, joined by \\n."""
    return let(lines_of(text), lambda lines: F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["len"]))), "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with n_lines, n_dropped, keep_runs and kept_text besides its own columns; see keep_bitmaps.

    Columns of docs with one of these names are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "keep_runs", "kept_text")
    id_, th_, gone_, dropped_ = unused(docs, "id", "th", "gone", "dropped")
    gone = keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).withColumnsRenamed({"doc_id": id_, "th": th_, "gone": gone_, "n_dropped": dropped_})
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(th_)), "left")
    n_lines, lost = F.size(lines_of(F.col("text"))), F.col(gone_).isNotNull()
    keep = F.when(lost, runs(F.col(gone_), n_lines)).otherwise(F.array(F.struct(F.lit(0).alias("start"), n_lines.alias("len"))))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.col(dropped_), F.lit(0)).cast("long").alias("n_dropped"),
        keep.alias("keep_runs"),
        F.when(lost, apply_runs(F.col("text"), runs(F.col(gone_), n_lines))).otherwise(F.coalesce(F.col("text"), F.lit(""))).alias("kept_text"),
    )


#: DuckDB: documents -> (doc_id, n_lines, n_dropped, kept_text); one row per doc_id is assumed.
SQL = """
line_rows AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {docs})),
line_stats AS (
  SELECT line_key, max(doc_id) AS keeper FROM line_rows WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
line_kept AS (
  SELECT r.doc_id, r.pos, r.line, s.keeper IS NULL OR s.keeper = r.doc_id AS stays
  FROM line_rows r LEFT JOIN line_stats s ON r.line_key = s.line_key),
line_docs AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (NOT stays) AS BIGINT) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS kept_text
  FROM line_kept GROUP BY doc_id)
"""
