"""Transaction pools, call traces and samples of user code."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_costly(pool: DataFrame, too_costly: Column, strict: bool = True) -> DataFrame:
    """pool (account, nonce, ...) without rows that cost too much; if strict, without all later nonces of their account."""
    low = F.min(F.when(too_costly, F.col("nonce"))).over(Window.partitionBy("account"))
    if not strict:
        return pool.where(~too_costly)
    return pool.withColumn("_low", low).where(F.col("_low").isNull() | (F.col("nonce") < F.col("_low"))).drop("_low")


def by_price(pool: DataFrame) -> DataFrame:
    """pool in the order of a merge that always takes the best next row of any account: price down, then time, nonces of an account in order.

    A row can't come before those of smaller nonce, so it is placed by the least
    price up to its nonce; of equal ones the account that got there first goes on.
    """
    run = Window.partitionBy("account").orderBy("nonce").rowsBetween(Window.unboundedPreceding, 0)
    placed = pool.withColumn("_low", F.min("price").over(run))
    head = F.min("time").over(Window.partitionBy("account", "_low"))
    return placed.withColumn("_head", head).orderBy(F.desc("_low"), "_head", "account", "nonce").drop("_low", "_head")


def call_parents(calls: DataFrame) -> DataFrame:
    """calls (tx, seq, depth) with parent, the seq of the last call one level up (null at the top).

    Each call is placed on its own level as a parent and on the one above as a child;
    on a level the last parent before a child is its own. One window for all depths.
    """
    row = F.struct(*calls.columns)
    own = calls.select("tx", F.col("depth").cast("long").alias("_level"), "seq", F.col("seq").alias("_from"), F.lit(None).cast(calls.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    below = calls.select("tx", (F.col("depth") - 1).cast("long").alias("_level"), "seq", F.lit(None).cast(calls.schema["seq"].dataType).alias("_from"), row.alias("_row"))
    run = Window.partitionBy("tx", "_level").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = own.unionByName(below).withColumn("parent", F.last("_from", ignorenulls=True).over(run)).where(F.col("_row").isNotNull())
    return placed.select("_row.*", "parent")


#: name -> (aggregates of the steps of a transaction), or (function of its ordered steps, schema of what it returns).
TRACERS: dict[str, dict[str, Column] | tuple[Callable[[pd.DataFrame], pd.DataFrame], str]] = {}


def tracer(name: str, schema: str):
    """Register a function of the ordered steps of one transaction; schema is that of what it returns. For tracers that need order."""

    def keep(f):
        TRACERS[name] = (f, schema)
        return f

    return keep


def column_tracer(name: str, aggregates: Callable[[], dict[str, Column]]) -> None:
    """Register a tracer made of aggregates; made when used, since columns need a session."""
    TRACERS[name] = aggregates


def run_tracer(name: str, steps: DataFrame, tx: str = "tx", order: str = "seq") -> DataFrame:
    found = TRACERS[name]
    if callable(found):
        return steps.groupBy(tx).agg(*[c.alias(n) for n, c in found().items()])
    f, schema = found
    return steps.groupBy(tx).applyInPandas(lambda rows: f(rows.sort_values(order)), schema)


def run_tracers(names: list[str], steps: DataFrame, tx: str = "tx", order: str = "seq") -> DataFrame:
    """(tx, tracer, result as JSON) of several tracers, in one pass over the steps.

    Column tracers share one aggregation; functions get each transaction's steps once, sorted.
    """
    plain = {n: TRACERS[n]() for n in names if callable(TRACERS[n])}
    ordered = {n: TRACERS[n][0] for n in names if not callable(TRACERS[n])}
    parts = []
    if plain:
        each = steps.groupBy(tx).agg(*[F.struct(*[c.alias(k) for k, c in cols.items()]).alias(n) for n, cols in plain.items()])
        pairs = F.array(*[F.struct(F.lit(n).alias("tracer"), F.to_json(n).alias("result")) for n in plain])
        parts.append(each.select(F.col(tx).alias("tx"), F.inline(pairs)))
    if ordered:

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(order)
            out = [(n, f(rows).drop(columns=tx).to_json(orient="records")) for n, f in ordered.items()]
            return pd.DataFrame({"tx": rows[tx].iloc[0], "tracer": [o[0] for o in out], "result": [o[1] for o in out]})

        parts.append(steps.groupBy(tx).applyInPandas(run, f"tx {steps.schema[tx].dataType.simpleString()}, tracer string, result string"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


column_tracer("depths", lambda: {"deepest": F.max("depth"), "steps": F.count("*")})
column_tracer("opcodes", lambda: {"kinds": F.count_distinct("op"), "steps": F.count("*")})


@tracer("call_tree", "tx long, tree string")
def call_tree(rows: pd.DataFrame) -> pd.DataFrame:
    """The calls of one transaction as a nested tree: {"seq", "calls": [...]}; a stack holds the open calls."""
    import json

    roots: list[dict] = []
    stack: list[tuple[int, dict]] = []
    for seq, depth in zip(rows["seq"].tolist(), rows["depth"].tolist(), strict=True):
        node: dict = {"seq": seq, "calls": []}
        while stack and stack[-1][0] >= depth:
            stack.pop()
        (stack[-1][1]["calls"] if stack else roots).append(node)
        stack.append((depth, node))
    return pd.DataFrame({"tx": [rows["tx"].iloc[0]], "tree": [json.dumps(roots)]})
