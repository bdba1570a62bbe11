"""Query registry: each key maps to a Spark builder and (when SQL can express
it) the DuckDB oracle text over the same raw parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import q_activity, q_billing, q_admission, q_users, q_sources  # noqa: F401
    from . import q_assortment, q_unit_econ, q_market, q_listing, q_streaming  # noqa: F401
