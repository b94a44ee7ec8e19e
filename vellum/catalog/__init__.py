"""Registered queries: one per operator of the inventory, each with the DuckDB
SQL that computes the same rows from the same driver tables (when SQL can).

Every query reads whole tables.  Queries project to scalar columns (no maps or
nested arrays), round scores to 6 decimals, and cast counts to bigint, so the
Spark result and the SQL result compare value for value.
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
            raise KeyError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from . import (search_q, vector_q, corpus_q, quality_q, knn_q, mutate_q,  # noqa: F401
                   index_q, cells_q, io_q, embed_q, stream_q, where_q, near_q)
