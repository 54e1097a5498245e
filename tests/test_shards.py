import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import shards

KEYED = "series_id BIGINT, ts_ns BIGINT, value DOUBLE, ingest_seq BIGINT"


def uneven(n, rng):
    """Times of which one is far away and nine in ten lie within a small stretch."""
    wide = rng.integers(10**12, 2 * 10**12, n // 10)
    return np.concatenate([[0], wide, rng.integers(1_500_000_000_000, 1_500_000_100_000, n - 1 - n // 10)])


@pytest.mark.parametrize("halo_steps", [0, 3])
def test_shards_follow_rows_not_time(spark, halo_steps):
    rng = np.random.default_rng(20)
    rows = [(1, int(t), 1.0, 0) for t in uneven(20_000, rng)] + [(2, int(t), 1.0, 0) for t in rng.integers(0, 1000, 50)] + [(3, 5, 1.0, i) for i in range(900)]
    points = spark.createDataFrame(rows, KEYED)
    described = spark.createDataFrame([(i, 10) for i in (1, 2, 3)], "series_id BIGINT, step_ns BIGINT")
    plan = shards.plan_shards(points, described, step="step_ns", halo_steps=halo_steps, target_rows=200)
    found = shards.sharded(points, plan, ["halo_ns"], halo=halo_steps > 0).toPandas()
    own = found[(found.ts_ns >= found["shard"]) & (found.ts_ns < found.end_ns)]
    sizes = own.groupby(["series_id", "shard"]).size()
    assert sizes[1].max() <= 2 * 200 and len(sizes[1]) < 400 and sizes[3].tolist() == [900]
    assert sorted(own.ts_ns[own.series_id == 1]) == sorted(t for s, t, *_ in rows if s == 1)
    assert (own["shard"] % 10 == 0).all()
    # the shards of a series do not overlap, and each has exactly the rows within its halo
    for series, part in found.groupby("series_id"):
        spans = part[["shard", "end_ns"]].drop_duplicates().sort_values("shard").to_numpy()
        assert (spans[1:, 0] >= spans[:-1, 1]).all()
        times = np.sort([t for s, t, *_ in rows if s == series])
        halo = halo_steps * 10
        for (shard, end), block in part.groupby(["shard", "end_ns"]):
            want = times[(times >= shard - halo) & (times < end + halo)]
            # a row one halo before the begin or behind the end may or may not come along
            assert set(times[(times > shard - halo) & (times < end + halo - 1)]) <= set(block.ts_ns) <= set(times[(times >= shard - halo) & (times <= end + halo)]), (shard, end, len(want))


def test_an_even_series_needs_no_second_cut(spark):
    points = spark.range(5000).selectExpr("1L AS series_id", "id * 7 AS ts_ns")
    plan = shards.plan_shards(points, target_rows=100)
    assert plan.recut == () and shards.located(points, plan).groupBy("shard").count().agg(F.max("count")).first()[0] <= 101


def test_one_stray_time_does_not_undo_the_cut(spark):
    points = spark.range(100_000).selectExpr("1L AS series_id", "1700000000000000000 + id * 1000000000 AS ts_ns").union(spark.range(1).selectExpr("1L", "0L"))
    plan = shards.plan_shards(points, target_rows=5000)
    assert shards.located(points, plan).groupBy("shard").count().agg(F.max("count")).first()[0] <= 10_000
    assert shards.plan_shards(points.limit(0)).keys.count() == 0
