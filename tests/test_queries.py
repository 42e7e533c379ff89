"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from marlstone import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(rows):
    cell = lambda v: "null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, duck, name):
    out = registry.queries()[name](spark, SMALL)
    columns = sorted(out.columns)
    rows = [tuple(r) for r in out.select(*columns).collect()]
    if name not in registry.oracle_sql():
        assert rows
        return
    found = duck.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert len(found.description) == len(columns)
    assert plain(rows) == plain([[r[i] for i in at] for r in found.fetchall()])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["category", "op_type", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = registry.queries()["prefix_scan"](spark, SMALL)._jdf.queryExecution().toString()
    assert "StringStartsWith(p_name,small )" in plan and "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan
    plan = registry.queries()["log_filter_range"](spark, SMALL)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_orderkey,1000)" in plan and "LessThan(l_orderkey,2100)" in plan
    plan = registry.queries()["read_pairs_all_distances"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [lag") == 1  # all distances in one pass


def test_no_machine_paths():
    for top, _, names in os.walk(os.path.join(os.path.dirname(__file__), "..", "marlstone")):
        for n in names:
            if n.endswith(".py"):
                assert "/tmp/" not in open(os.path.join(top, n)).read()
