"""Registered queries against their DuckDB oracles on the smallest tables
(the driver runs the same comparison at sf 0.01)."""

import duckdb
import pytest

from vellum.catalog import ORACLE, QUERIES, load_all
from vellum.sources.tables import TABLES

from .conftest import SF

import tools.check_oracle as chk  # noqa: E402

load_all()
NAMES = ["search_filtered", "knn_join_grid", "knn_cells", "cells_build", "query_rejects", "renest_documents",
         "default_ids",
         "index_build", "add_chunks", "embed_hash", "stream_upsert", "median_split", "snapshot_roundtrip"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    s_cols, s_rows = chk.rows_of(QUERIES[name](spark, SF).toPandas())
    o_cols, o_rows = chk.rows_of(con.execute(ORACLE[name]).df())
    assert s_cols == o_cols
    assert len(s_rows) == len(o_rows)
    assert s_rows == o_rows


def test_every_query_has_a_docstring():
    assert all(fn.__doc__ for fn in QUERIES.values())
    assert len(QUERIES) >= 80 and len(ORACLE) >= len(QUERIES) - 1
