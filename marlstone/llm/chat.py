"""Chat formatting in Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of
one role share a block; blocks are concatenated:

    ### <role>:\\n<text>[<next><text>...]</turn>\\n

Inside roles and texts `\\`, `#`, `<` (and `:` in roles) are written `\\b`, `\\h`,
`\\l`, `\\c`, so that no text can hold a control string, and reading back is exact.
The loss mask is a list of (start, len) over the output, one for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, SPLIT, NEXT, CLOSE = "### ", ":\n", "<next>", "</turn>\n"
#: Code points of the pieces that a text is cut into to be read back.
PIECE = 4096
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(c: Column, role: bool = False) -> Column:
    for plain, coded in ESCAPES + (((":", "\\c"),) if role else ()):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for coded, plain in (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def prefix_sums(lens: Column, n: Column) -> Column:
    """The sum of all entries before each, in n * sqrt(n) steps."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    add = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)
    sums = F.transform(F.sequence(F.lit(0), F.floor(n / width).cast("int")), lambda b: add(F.slice(lens, b * width + 1, width)))
    before = let(sums, lambda blocks: F.transform(blocks, lambda _, b: add(F.slice(blocks, F.lit(1), b))))
    at = lambda blocks, i: F.get(blocks, F.floor(i / width).cast("int")) + add(F.slice(lens, (F.floor(i / width) * width + 1).cast("int"), (i % width).cast("int")))
    return let(before, lambda blocks: F.transform(lens, lambda _, i: at(blocks, i)))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_mask) for each conversation.

    turns: conv_id, turn, role, text; other columns are ignored. Turns are ordered
    by turn (null first), then role and text, so ties and repeated rows have a
    fixed order and all of them stay. Null role or text is empty. Rows of null
    conv_id are one conversation. An empty table gives none. A conversation is one
    string, so Spark's limit of 2 GB a value holds for each.
    """
    struct = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(struct)).alias("t"))
    t = F.col("t")
    same = lambda i, j: F.get(t, i)["role"] == F.get(t, j)["role"]
    piece = lambda x, i: F.struct(
        F.when((i > 0) & same(i - 1, i), F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), escape(x["role"], True), F.lit(SPLIT))).alias("head"),
        escape(x["text"]).alias("body"),
        F.when((i + 1 < F.size(t)) & same(i, F.least(i + 1, F.size(t) - 1)), F.lit("")).otherwise(F.lit(CLOSE)).alias("tail"),
        x["role"].isin(*loss_roles).alias("loss"),
    )
    pieces = convs.select("conv_id", F.transform("t", piece).alias("p"))
    whole = lambda x: F.concat(x["head"], x["body"], x["tail"])
    sized = pieces.select("conv_id", "p", F.array_join(F.transform("p", whole), "").alias("formatted"), F.transform("p", lambda x: F.char_length(whole(x)).cast("long")).alias("lens"))
    placed = sized.select("conv_id", "formatted", "p", prefix_sums(F.col("lens"), F.size("lens")).alias("at"))
    span = lambda x, start: F.struct((start + F.char_length(x["head"])).alias("start"), F.char_length(x["body"]).cast("long").alias("len"), x["loss"].alias("loss"))
    masked = F.transform(F.filter(F.zip_with("p", "at", span), lambda s: s["loss"]), lambda s: F.struct(s["start"], s["len"]))
    return placed.select("conv_id", "formatted", masked.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds, adjacent turns apart."""
    def block(b: Column) -> Column:
        role, body = unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), SPLIT, 1)), F.substr(b, F.instr(b, SPLIT) + len(SPLIT))
        return let(role, lambda r: F.transform(F.split(body, NEXT), lambda text: F.struct(r.alias("role"), unescape(text).alias("text"))))

    return F.flatten(F.transform(F.filter(F.split(formatted, CLOSE), lambda b: b != ""), block))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped. The text is cut into pieces first, so a span costs its own length and a piece, wherever it lies."""
    piece = lambda at: F.floor(at / PIECE).cast("int")

    def span(pieces: Column, s: Column) -> Column:
        first = piece(s["start"])
        near = F.array_join(F.slice(pieces, first + 1, piece(s["start"] + s["len"]) - first + 1), "")
        return unescape(F.substring(near, (s["start"] % PIECE + 1).cast("int"), s["len"].cast("int")))

    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(pieces, lambda x: F.array_join(F.transform(mask, lambda s: span(x, s)), ""))


#: DuckDB: conversations and the two rows of conversation -7.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'),
                                  (CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '\### Assistant: </turn> ok'))),
marked AS (
  SELECT *, coalesce(role = lag(role) OVER w, false) AS joined, coalesce(role = lead(role) OVER w, false) AS joins
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))
         + CASE WHEN joined THEN 6 ELSE 6 + length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) END
         + CASE WHEN joins THEN 0 ELSE 8 END AS chars
  FROM marked)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
