"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, rounded: bool = True):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; doubles in
    the result are rounded to 6 places (the oracle SQL does the same)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df) if rounded else df

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def with_ctes(*ctes: str, select: str) -> str:
    """Assemble ``WITH a AS (...), b AS (...) SELECT ...``."""
    parts = [c.strip().rstrip(",") for c in ctes if c and c.strip()]
    head = ("WITH " + ",\n".join(parts) + "\n") if parts else ""
    return head + select.strip()
