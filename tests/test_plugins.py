"""User code at each of the places for it."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.functions.codecs import rlp_encode
from marlstone.operators import plugins
from marlstone.streaming import streams


def test_dump_collector(spark, tmp_path):
    roots = []

    def keep(rows, path=str(tmp_path)):
        import uuid

        with open(f"{path}/{uuid.uuid4().hex}.txt", "w") as out:
            out.writelines(f"{r.id}\n" for r in rows)

    plugins.collect_dump(spark.range(20, numPartitions=3), "0xab", roots.append, keep)
    assert roots == ["0xab"] and sorted(int(r.value) for r in spark.read.text(f"{tmp_path}/*.txt").collect()) == list(range(20))


def test_write_hooks(spark):
    seen = []
    note = lambda name: lambda rows, batch: seen.append((name, batch, rows.count()))
    df = spark.createDataFrame([("Put", 1), ("BatchPut", 2), ("BatchDelete", 3), ("Get", 4)], "op string, key int")
    plugins.write_hook(note("put"), note("delete"), note("all"))(df, 7)
    plugins.write_hook(on_delete=note("delete"))(df.limit(0), 8)
    assert seen == [("put", 7, 2), ("delete", 7, 1), ("all", 7, 4), ("delete", 8, 0)]


def test_section_backend(spark):
    done = []

    class Backend(plugins.SectionBackend):
        def reset(self, section):
            done.append(("reset", section))

        def process(self, section, rows):
            done.append(("process", section, rows.count()))

        def commit(self, section):
            done.append(("commit", section))

        def prune(self, section):
            done.append(("prune", section))

    rows = spark.range(35).select(F.col("id").alias("block_number"))
    life = streams.Sections(10, 3)
    for head, reorg in ((22, False), (12, True)):
        plugins.drive_sections(life.step(head, reorg), rows, Backend(), 10)
    assert done == [("reset", 0), ("process", 0, 10), ("commit", 0), ("reset", 1), ("process", 1, 10), ("commit", 1), ("prune", 1)]


def test_overrides(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", None), (None, "c", 7)], "k int, v string, w int")
    other = spark.createDataFrame([(1, "z", None), (9, "y", 1), (2, None, 8)], "k int, v string, w int")
    assert sorted(map(tuple, plugins.resolved(rows, other, ["k"]).collect()), key=str) == sorted([(1, "z", 5), (2, "b", 8), (None, "c", 7)], key=str)


def test_filters_by_flag(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    df = spark.createDataFrame([("a", "10.0.0.1", t(0), t(3), {"eth": "f1", "snap": ""}), ("b", "10.9.0.1", t(0), t(1), {"eth": "f2", "les": ""})], "id string, ip string, first_response timestamp, last_response timestamp, record map<string,string>")
    pick = lambda *a: [r.id for r in plugins.filter_nodes(df, list(a)).orderBy("id").collect()]
    assert pick() == ["a", "b"] and pick("-ip", "10.0.0.0/16", "-snap") == ["a"] and pick("-min-age", "1h30m") == ["a"] and pick("-min-age", "3600s") == ["a", "b"]
    assert pick("-eth-network", "f2,f3", "-les-server") == ["b"]
    for bad in (["-nope"], ["-ip"], ["-min-age", "soon"]):
        with pytest.raises(ValueError):
            plugins.filter_nodes(df, bad)


def test_exporters(spark):
    kv = spark.createDataFrame([(b"secure-key-" + b"h" * 32, b"1"), (b"a" + b"h" * 32, b"2"), (b"o" + b"h" * 64, b"3"), (b"c" + b"h" * 32, b"4"), (b"hx", b"5")], "key binary, value binary")
    got = {name: sorted(bytes(r.value) for r in f(kv).collect()) for name, f in plugins.EXPORTERS.items()}
    assert got == {"preimage": [b"1"], "snapshot": [b"2", b"3", b"4"]}


def test_records_by_schema(spark):
    read = plugins.rlp_as("n long, s string, ok boolean, big decimal(38,0), xs array<long>, b binary")
    good = [b"\x05", b"hi", b"\x01", (10**30).to_bytes(13, "big"), [b"\x01", b"", b"\x01\x00"], b"\x00"]
    bad = [[*good[:2]], [b"\0\x05", *good[1:]], [good[0], b"\xff", *good[2:]], [*good[:2], b"\x02", *good[3:]], [*good[:4], b"x", good[5]], [b"\xff" * 9, *good[1:]], [[], *good[1:]]]
    df = spark.createDataFrame([(rlp_encode(good),), *[(rlp_encode(x),) for x in bad], (rlp_encode(good) + b"x",), (None,)], "r binary")
    got = [r[0] for r in df.select(read("r")).collect()]
    assert (got[0].n, got[0].s, got[0].ok, int(got[0].big), got[0].xs, bytes(got[0].b)) == (5, "hi", True, 10**30, [1, 0, 256], b"\x00")
    assert got[1:] == [None] * 9


def test_stepwise_tracers_keep_order_and_faults():
    import pandas as pd

    class Log:
        def setup(self):
            self.said = []

        def step(self, row):
            self.said.append(row["op"])

        def fault(self, row):
            self.said.append("!" + row["op"])

        def result(self):
            return {"said": ",".join(self.said)}

    rows = pd.DataFrame({"tx": [4, 4, 4], "op": ["a", "b", "c"], "error": [False, True, None]})
    assert plugins.stepwise(Log)(rows).to_dict("records") == [{"tx": 4, "said": "a,!b,c"}]
    assert plugins.stepwise(plugins.Bigrams)(rows).bigrams[0] == '{"a-b":1,"b-c":1}'
