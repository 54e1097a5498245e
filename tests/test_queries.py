import pytest
from tables import FOLDER, assert_equal_to_sql, needs_tables

from chronoloom import engine_queries, timeseries_queries

QUERIES = engine_queries.QUERIES | timeseries_queries.QUERIES
SQL = engine_queries.SQL | timeseries_queries.SQL


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert_equal_to_sql(spark, QUERIES[name], SQL[name])


@needs_tables
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    found = QUERIES[name](spark, str(FOLDER))
    rows = found.collect()
    assert found.columns and len({repr(r) for r in rows}) == len(rows)
