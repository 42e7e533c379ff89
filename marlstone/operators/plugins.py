"""Places for user code: row sinks, write hooks, section processors, lookup overrides, filters by flag, exporters by name, records by schema."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.categories import OP_RULES
from marlstone.functions.codecs import in_network, rlp_decode


def collect_dump(accounts: DataFrame, root: str, on_root: Callable[[str], None], on_accounts: Callable[[Iterator], None]) -> None:
    """A state for a collector: on_root once on the driver, then on_accounts in executors, with the rows of one partition each."""
    on_root(root)
    accounts.foreachPartition(on_accounts)


def write_hook(on_put: Callable[[DataFrame, int], None] | None = None, on_delete: Callable[[DataFrame, int], None] | None = None, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function of a batch (op, key, value) and its number, for foreachBatch: puts go to one hook, deletes to another, then all to `then`."""

    def run(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            for hook, ops in ((on_put, ("Put", "BatchPut")), (on_delete, ("Delete", "BatchDelete"))):
                if hook:
                    hook(rows.where(F.col("op").isin(*ops)), batch)
            if then:
                then(rows, batch)
        finally:
            rows.unpersist()

    return run


class SectionBackend:
    """What is done with a section. Overwrite what is needed; a section may be reset and processed again at any time."""

    def reset(self, section: int) -> None:
        """A new section begins: what an earlier try left goes."""

    def process(self, section: int, rows: DataFrame) -> None:
        """The rows of the whole section."""

    def commit(self, section: int) -> None:
        """The section is done."""

    def prune(self, section: int) -> None:
        """A reorg took the section back."""


def drive_sections(events: Iterable[tuple[int, str]], rows: DataFrame, backend: SectionBackend, size: int) -> None:
    """Lead a backend through (section, action) as Sections.step gives them; rows have block_number."""
    for section, action in events:
        if action == "process":
            backend.process(section, rows.where(F.col("block_number").between(section * size, section * size + size - 1)))
        else:
            {"reset": backend.reset, "commit": backend.commit, "rollback": backend.prune}[action](section)


def resolved(rows: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of overrides (keys, ...) wherever it has a row of the keys and a value; one row a key is taken to be there."""
    named = overrides.select(*keys, *[F.col(c).alias(f"_{c}") for c in overrides.columns if c not in keys])
    columns = [F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in named.columns else F.col(c) for c in rows.columns]
    return rows.join(named, keys, "left").select(*columns)


def _seconds(text: str) -> float:
    """A duration such as 1h30m or 45s."""
    unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
    parts = re.findall(r"([0-9.]+)(ms|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"no duration: {text}")
    return sum(float(n) * unit[u] for n, u in parts)


#: Flag -> (number of its arguments, arguments -> test of a node: ip, first_response, last_response, record).
NODE_FILTERS: dict[str, tuple[int, Callable[..., Column]]] = {
    "-ip": (1, lambda network: in_network(F.col("ip"), network)),
    "-min-age": (1, lambda age: F.unix_micros(F.col("last_response").cast("timestamp")) - F.unix_micros(F.col("first_response").cast("timestamp")) >= int(_seconds(age) * 1_000_000)),
    "-eth-network": (1, lambda forks: F.coalesce(F.try_element_at("record", F.lit("eth")).isin(*forks.split(",")), F.lit(False))),
    "-snap": (0, lambda: F.map_contains_key("record", "snap")),
    "-les-server": (0, lambda: F.map_contains_key("record", "les")),
}


def filter_nodes(nodes: DataFrame, args: list[str]) -> DataFrame:
    """Nodes that pass all flags of a command line; a flag unknown or short of arguments is an error."""
    tests, rest = [], list(args)
    while rest:
        flag = rest.pop(0)
        if flag not in NODE_FILTERS:
            raise ValueError(f"no filter {flag}")
        n, build = NODE_FILTERS[flag]
        if len(rest) < n:
            raise ValueError(f"{flag} wants {n} arguments")
        tests.append(build(*rest[:n]))
        del rest[:n]
    return nodes.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def under(*categories: str) -> Callable[[DataFrame], DataFrame]:
    prefixes = [p for p, c in OP_RULES if c in categories]
    return lambda kv: kv.where(reduce(lambda a, b: a | b, (F.lower(F.hex("key")).startswith(p) for p in prefixes))).select(F.lit(0).alias("op"), "key", "value")


#: Name of an export -> what it takes of a store (key, value), as rows of a dump (op, key, value).
EXPORTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"preimage": under("PreimagePrefix"), "snapshot": under("SnapshotAccountPrefix", "SnapshotStoragePrefix", "CodePrefix")}


def rlp_as(schema: str):
    """A column function: encoded lists as structs of a DDL schema of long, decimal, string, binary, boolean and arrays of them; null where a value doesn't fit.

    Numbers must be in shortest form; a list must have as many items as the schema fields.
    """
    fields = T._parse_datatype_string(schema).fields

    def value(item, kind: T.DataType):
        if isinstance(kind, T.ArrayType):
            if isinstance(item, bytes):
                raise ValueError("not a list")
            return [value(x, kind.elementType) for x in item]
        if not isinstance(item, bytes):
            raise ValueError("a list")
        if isinstance(kind, T.BinaryType):
            return item
        if isinstance(kind, T.StringType):
            return item.decode()
        if item[:1] == b"\0":
            raise ValueError("not the shortest form")
        number = int.from_bytes(item, "big")
        if isinstance(kind, T.BooleanType):
            if number > 1:
                raise ValueError("no truth value")
            return bool(number)
        if isinstance(kind, T.DecimalType):
            from decimal import Decimal

            return Decimal(number) if number < 10**kind.precision else _too_large()
        return number if number < 2**63 else _too_large()

    def one(data) -> dict | None:
        try:
            items, end = rlp_decode(bytes(data))
            if end != len(data) or isinstance(items, bytes) or len(items) != len(fields):
                return None
            return {f.name: value(x, f.dataType) for f, x in zip(fields, items, strict=True)}
        except (ValueError, UnicodeDecodeError):
            return None

    @F.udf(T.StructType(fields), useArrow=True)
    def run(data):
        return None if data is None else one(data)

    return run


def _too_large():
    raise ValueError("too large a number")


def stepwise(make: Callable[[], object]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A tracer of a transaction's ordered steps from an object with step(row), and, if it has them, setup(), fault(row) and result().

    Rows with a true `error` go to fault, the others to step; result() gives one row as a dict.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = make()
        if hasattr(own, "setup"):
            own.setup()
        for row in rows.to_dict("records"):
            (own.fault if row.get("error") and hasattr(own, "fault") else own.step)(row)
        return pd.DataFrame([{"tx": rows["tx"].iloc[0], **own.result()}])

    return run


class Bigrams:
    """Counts of neighbouring operations of a transaction, as JSON."""

    def setup(self) -> None:
        self.last, self.counts = "", {}

    def step(self, row: dict) -> None:
        if self.last:
            gram = f"{self.last}-{row['op']}"
            self.counts[gram] = self.counts.get(gram, 0) + 1
        self.last = row["op"]

    def result(self) -> dict:
        import json

        return {"bigrams": json.dumps(dict(sorted(self.counts.items())), separators=(",", ":"))}
