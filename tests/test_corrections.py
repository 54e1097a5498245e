"""Trees corrected by late writes equal trees built of all writes."""

import random

import pytest

from chronoloom.operators import rolling, shards

DAY = rolling.DAY_NS
INF, NAN = float("inf"), float("nan")


def trees_of(points, described):
    return rolling.build_trees(rolling.daily_totals(shards.current_readings(points, described)))


def rows_of(trees):
    return sorted(map(repr, rolling.rolling_totals(trees, (7, 30), from_day=0).collect()))


@pytest.fixture
def described(spark):
    return spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "series_id BIGINT, n INT")


def both_ways(points, described, after):
    early = trees_of(points.where(f"ingest_seq <= {after}"), described)
    corrected = rolling.replace_days(early, rolling.days_of_late_writes(points, described, after))
    assert rows_of(corrected) == rows_of(trees_of(points, described))
    assert sorted(map(repr, corrected.select("series_id", "shard", "first_day", "last_day").collect())) == sorted(map(repr, trees_of(points, described).select("series_id", "shard", "first_day", "last_day").collect()))


def test_overwritten_deleted_infinite_and_new(make_points, described):
    rows = [(1, d * DAY + 5, float(d), d) for d in range(0, 90, 3)]
    rows += [(2, 5, INF, 1), (2, 40 * DAY, 2.0, 2), (3, 7 * DAY, 1.0, 3)]
    rows += [
        (1, 30 * DAY + 5, 100.0, 200), (1, 0 * DAY + 5, None, 201), (1, 87 * DAY + 5, NAN, 202), (1, 500 * DAY, 4.0, 203),
        (2, 5, 3.0, 204), (3, 7 * DAY, None, 205), (4, 9 * DAY, 8.0, 206), (4, 9 * DAY, 8.0, 206), (9, 1, 1.0, 207), (1, 33 * DAY + 5, -1.0, 1),
    ]
    both_ways(make_points(rows), described, 150)


def test_random_writes(make_points, described):
    rng = random.Random(16)
    rows = [(rng.randint(1, 4), rng.randrange(100) * DAY + rng.randrange(3), rng.choice([None, NAN, 1.0, 2.0, 5.0]), seq) for seq in range(600)]
    both_ways(make_points(rows), described, 500)


def test_nothing_late_and_nothing_early(make_points, described):
    points = make_points([(1, 3 * DAY, 1.0, 1), (2, 5 * DAY, 2.0, 2)])
    both_ways(points, described, 10)
    both_ways(points, described, 0)
    both_ways(points.limit(0), described, 0)
