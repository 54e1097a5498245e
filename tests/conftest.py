import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DAY = 86_400_000_000_000
POINTS = "series_id BIGINT, ts_ns BIGINT, value DOUBLE, ingest_seq BIGINT"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_points(spark):
    """Points with columns of clashing names added, and rows that are no readings."""

    def make(rows, noise=True):
        rows = [(*r, None, None) if len(r) == 3 else (*r, None) for r in [(*x, 0) if len(x) == 3 else x for x in rows]]
        rows = [r[:4] for r in rows]
        if noise and rows:
            rows += [(None, 5, 1.0, 1), (rows[0][0], None, 1.0, 1), (rows[0][0], -7, 1.0, 1)]
        df = spark.createDataFrame(rows, POINTS)
        return df.selectExpr("*", "7 AS shard", "'x' AS metric", "1 AS n", "0 AS width_ns", "'y' AS lo", "2 AS _salt")

    return make
