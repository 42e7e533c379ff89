import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import chat


def back(df):
    out = chat.format_chats(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return {r.conv_id: ([tuple(x) for x in r.t], r.loss) for r in out.collect()}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:\n#", ""]), st.text("\\#<>/turnex:\n bhlc", max_size=12)), min_size=1, max_size=9), min_size=1, max_size=8))
def test_round_trip(spark, convs):
    rows = [(c, i, role, text) for c, conv in enumerate(convs) for i, (role, text) in enumerate(conv)]
    got = back(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for c, conv in enumerate(convs):
        assert got[c] == (conv, "".join(t for r, t in conv if r == "assistant"))


def test_nulls_ties_repeats_and_long(spark):
    rows = [(1, None, "user", "z"), (1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (None, 1, "assistant", "x" * 200_000), (2, 5, "system", "")]
    rows += [(3, i, "assistant" if i % 3 else "user", f"<next>{i}</turn>\n### user:\n") for i in range(2000)]
    got = back(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    assert got[1] == ([("user", "z"), ("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], "aab")
    assert got[None] == ([("assistant", "x" * 200_000)], "x" * 200_000)
    assert got[2] == ([("system", "")], "")
    assert got[3][0] == [(r[2], r[3]) for r in rows if r[0] == 3]


def test_adjacent_turns_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).first().formatted == "### user:\na<next>b</turn>\n### assistant:\nc</turn>\n"


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    assert back(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == {}


def test_a_very_long_turn(spark):
    long = "\\#<x" * 1_000_000
    got = back(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string"))
    assert got[1] == ([("user", "q"), ("assistant", long)], long)


def test_many_turns_are_read_back_in_linear_time(spark):
    import time

    took = []
    for n in (4000, 16_000):
        df = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('é\U0001f600 turn # ', id, ' ', repeat('text ', 10)) text")
        began = time.monotonic()
        turns, loss = back(df)[1]
        took.append(time.monotonic() - began)
        assert len(turns) == n and loss == "".join(t for r, t in turns if r == "assistant")
    assert took[1] < 4 * took[0] + 10
