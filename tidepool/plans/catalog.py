"""Registry of checked queries: name → Spark callable and (optionally) oracle SQL.

Every callable takes ``(spark, sf_dir)`` and returns a flat DataFrame
(scalars only, arrays joined with '|', integers as bigint, dates as
strings).  The oracle SQL is an independent DuckDB statement over the same
parquet tables; queries without one get a rows-only check plus unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so its queries register themselves."""
    from tidepool.plans import (  # noqa: F401
        catalog_audit, catalog_digest, catalog_ingest, catalog_records, catalog_stream, catalog_text)
