"""Named queries over the driver tables, each with its DuckDB SQL."""

from __future__ import annotations

from marlstone.plans import catalog, ledger  # noqa: F401, each adds its queries


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
