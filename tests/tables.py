"""Compare a registered query with its SQL over the smallest test tables."""

import math
from pathlib import Path

import pytest

FOLDER = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not FOLDER.exists(), reason="the test tables are not here")


def _plain(row):
    return tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in row)


def assert_equal_to_sql(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = query(spark, str(FOLDER))
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})")
    got_rows = sorted((_plain(r) for r in found.select(*columns).collect()), key=repr)
    want_rows = sorted((_plain(r) for r in want.fetchall()), key=repr)
    assert got_rows == want_rows
