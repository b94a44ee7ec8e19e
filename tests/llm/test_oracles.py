"""Registered queries of the subpackage against their SQL, on the smallest tables."""

import duckdb
import pytest

import tools.check_oracle as chk
from vellum.llm.queries import ORACLE, QUERIES
from vellum.sources.tables import TABLES

from ..conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, con, name):
    s_cols, s_rows = chk.rows_of(QUERIES[name](spark, SF).toPandas())
    o_cols, o_rows = chk.rows_of(con.execute(ORACLE[name]).df())
    assert s_cols == o_cols and len(s_rows) > 0
    assert s_rows == o_rows


def test_thirteen_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and all(f.__doc__ for f in QUERIES.values())
