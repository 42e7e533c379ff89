"""Streams that come in several runs, against what one pass gives."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions.checkpoints import shared_folder, work_folder
from marlstone.streaming import streams

LINES = [
    ["Processing block (start), ID: 5, hash: 0xab", "OPType: Get, key: 41aa, size: 2"],
    ["OPType: Put, key: 41ab, size: 2, value: 00, size: 1", "Processing block (end), ID: 5, hash: 0xab", ""],
]


def put(spark, folder, n, lines):
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("append").text(f"{folder}")


def test_tailing_goes_on_where_it_stopped(spark, tmp_path):
    src, out = f"{tmp_path}/trace", f"{tmp_path}/out"
    put(spark, src, 0, LINES[0])
    read = lambda: sorted(map(str, streams.drained(streams.tail(spark, src).select("op_type", "key", "start_id", "end_id"), folder=out).collect()))
    first = ["Row(op_type='Get', key='41aa', start_id=None, end_id=None)", "Row(op_type=None, key=None, start_id=5, end_id=None)"]
    assert read() == first
    put(spark, src, 1, LINES[1])
    assert read() == sorted([*first, "Row(op_type='Put', key='41ab', start_id=None, end_id=None)", "Row(op_type=None, key=None, start_id=None, end_id=5)", "Row(op_type=None, key=None, start_id=None, end_id=None)"])


def test_a_poll_gives_changes_alone_and_is_forgotten(spark, tmp_path):
    src, now = f"{tmp_path}/src", [0.0]
    spark.range(3).write.parquet(src)
    poll = streams.Poll(streams.read(spark, src), f"{tmp_path}/poll", ttl=300, clock=lambda: now[0])
    assert sorted(r.id for r in poll.changes().collect()) == [0, 1, 2]
    now[0] = 299.0
    assert poll.changes().count() == 0
    spark.range(10, 12).write.mode("append").parquet(src)
    now[0] = 500.0
    assert sorted(r.id for r in poll.changes().collect()) == [10, 11]
    now[0] = 801.0
    with pytest.raises(KeyError):
        poll.changes()


def test_sections_by_hand():
    life = streams.Sections(10, 3)
    assert life.step(8, False) == [] and life.step(11, False) == []  # the last block of section 0 is 9; three must lie on it
    assert life.step(12, False) == [(0, "reset"), (0, "process"), (0, "commit")]
    assert [s for s, a in life.step(45, False) if a == "commit"] == [1, 2, 3]
    assert life.step(25, True) == [(3, "rollback"), (2, "rollback")] and life.known == 2
    assert life.step(20, False) == [] and life.known == 2
    assert life.step(1, True) == [(1, "rollback"), (0, "rollback")]


def test_sections_in_several_runs(spark, tmp_path):
    src, out = f"{tmp_path}/heads", f"{tmp_path}/out"
    schema = "chain string, seq long, head long, reorg boolean"
    runs = [[("a", 0, 25, False), ("b", 1, 5, False)], [("a", 2, 52, False), ("a", 3, 30, True), ("b", 4, 33, False)], [("a", 5, 42, False)]]
    life, want = {k: streams.Sections(10, 3) for k in "ab"}, []
    for part in runs:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        got = streams.drained(streams.section_events(streams.read(spark, src), 10, 3), folder=out)
        want += [(c, q, n, s, a) for c, q, h, r in part for n, (s, a) in enumerate(life[c].step(h, r))]
        assert sorted(map(tuple, got.select("chain", "seq", "nth", "section", "action").collect())) == sorted(want)
    assert sorted(map(tuple, streams.live_sections(got).collect())) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 2)]


def test_meter_decays_as_published():
    meter = streams.Meter()
    meter.tick(3)
    assert meter.rates == (0.6, 0.6, 0.6) and meter.mean == 0.6
    for want in (0.22072766470286553, 0.08120116994196772, 0.029872241020718428):
        for _ in range(12):
            meter.tick(0)
        assert abs(meter.rates[0] - want) < 1e-12


def test_meters_in_several_runs(spark, tmp_path):
    src, out = f"{tmp_path}/ticks", f"{tmp_path}/out"
    alone = streams.Meter()
    want = {}
    ticks = [(0, 3), (1, 0), (2, 7), (5, 1), (6, 2)]
    last = -1
    for tick, n in ticks:
        for _ in range(tick - last - 1):
            alone.tick(0)
        alone.tick(n)
        last, want[tick] = tick, (alone.mean, *alone.rates)
    for part in (ticks[:2], ticks[2:4], ticks[4:]):
        spark.createDataFrame([("m", t, n) for t, n in part], "name string, tick long, n long").write.mode("append").parquet(src)
        got = streams.drained(streams.meters(streams.read(spark, src)), folder=out)
    for r in got.collect():
        assert all(abs(x - y) < 1e-12 for x, y in zip((r["mean"], r.rate1, r.rate5, r.rate15), want[r.tick], strict=True))
    assert got.count() == 5


def test_a_feed_reaches_all_and_repeats_after_a_failure(spark, tmp_path):
    src, seen, fail = f"{tmp_path}/src", ([], []), [True]
    spark.range(4).write.parquet(src)

    def second(rows, batch):
        if fail.pop() if fail else False:
            raise RuntimeError("not now")
        seen[1].append(rows.count())

    subscribers = [lambda rows, batch: seen[0].append(rows.count()), second]
    with pytest.raises(Exception, match="not now"):
        streams.feed(streams.read(spark, src), subscribers, f"{tmp_path}/feed").awaitTermination()
    streams.feed(streams.read(spark, src), subscribers, f"{tmp_path}/feed").awaitTermination()
    assert seen == ([4, 4], [4])


def test_windows_close_when_late(spark, tmp_path):
    src, out = f"{tmp_path}/t", f"{tmp_path}/out"
    at = lambda d, h: F.make_timestamp(F.lit(2024), F.lit(1), F.lit(d), F.lit(h), F.lit(0), F.lit(0))
    for day in (1, 2, 4, 1):  # the last one is too late
        spark.range(3).select(at(day, 5).alias("ts"), F.lit("c").alias("category"), F.lit("Get").alias("op_type")).write.mode("append").parquet(src)
        got = streams.drained(streams.op_counts(streams.read(spark, src)), folder=out)
    assert sorted((r.window.start.day, r.n) for r in got.collect()) == [(1, 3), (2, 3)]


def test_working_folders(spark):
    a, b = work_folder(spark, "x"), work_folder(spark, "x")
    assert a != b and a.startswith(shared_folder(spark))
