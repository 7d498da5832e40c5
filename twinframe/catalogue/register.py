"""The register of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with SQL where SQL can express it."""
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Round for comparison between engines, without a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def edits_text(edits: str) -> Column:
    """Edit events as one line of text."""
    return F.expr(
        f"array_join(transform({edits}, e -> concat_ws(':', e.position, e.ref, e.var, e.type)), ';')")
