"""Registry of queries; each plan module registers its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that says the same for another engine."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple]) -> str:
    """Rows as an SQL VALUES list."""
    quote = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


def fill(template: str, *parts: str | int) -> str:
    """The template with {0}, {1} ... replaced; other braces stay."""
    for i, part in enumerate(parts):
        template = template.replace("{%d}" % i, str(part))
    return template
