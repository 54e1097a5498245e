import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from tables import FOLDER, assert_equal_to_sql, needs_tables  # noqa: E402

from chronoloom.llm import queries  # noqa: E402


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert_equal_to_sql(spark, queries.QUERIES[name], queries.SQL[name])


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    rows = queries.QUERIES[name](spark, str(FOLDER)).collect()
    assert len({repr(r) for r in rows}) == len(rows)
