import math
import random

import numpy as np
import pytest

from chronoloom.operators import grid, hotkeys, rolling, shards, spikes
from chronoloom.operators import staging
from chronoloom.operators.staging import join_dimension

DAY = rolling.DAY_NS
INF, NAN = float("inf"), float("nan")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# -- readings


def test_current_readings(spark, make_points):
    points = make_points([(1, 10, 1.0, 1), (1, 10, 2.0, 2), (1, 10, 2.0, 2), (1, 11, None, 3), (1, 11, 5.0, 2), (1, 12, NAN, 1), (1, 13, INF, 1), (2, 10, 3.0, None), (3, 10, 9.0, 1)])
    wanted = spark.createDataFrame([(1, "a"), (2, "b")], "series_id BIGINT, value STRING")
    assert rows_of(shards.current_readings(points, wanted)) == [(1, 10, 2.0), (1, 13, INF), (2, 10, 3.0)]


def test_whole_shards_never_cuts_a_shard():
    import pyarrow as pa

    rng = random.Random(1)
    keys = [(s, k) for s in range(20) for k in range(3) for _ in range(rng.randint(0, 40))]
    table = pa.table({"series_id": [k[0] for k in keys], "shard": [k[1] for k in keys], "value": [None if i % 7 == 0 else float(i) for i in range(len(keys))]})
    for size in (1, 13, 1000):
        blocks = list(shards.whole_shards(table.to_batches(max_chunksize=size), least=50))
        seen = [set(zip(b["series_id"].tolist(), b["shard"].tolist())) for b in blocks]
        assert sum(len(b["shard"]) for b in blocks) == len(keys)
        assert all(not (a & b) for i, a in enumerate(seen) for b in seen[i + 1 :])


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_large_join_equals_broadcast(spark, monkeypatch, hot_rows):
    from pyspark.sql import functions as F

    monkeypatch.setattr(staging, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(staging, "HOT_PARTS", 4)
    facts = spark.range(500).selectExpr("if(id < 300, 0, id % 40) AS k", "id AS v")
    dimension = spark.range(60).selectExpr("id - 5 AS k", "concat('n', id) AS name")
    assert {r["k"]: r["_slices"] for r in staging.hot_keys(facts, ["k"]).collect()} == ({0: 3} if hot_rows == 10 else {})
    for how in ("inner", "left", "left_anti"):
        large = join_dimension(facts, dimension, "k", F.col("v"), how, most=0)
        assert sorted(map(str, large.collect())) == sorted(map(str, join_dimension(facts, dimension, "k", F.col("v"), how).collect()))
    assert join_dimension(facts.limit(0), dimension, "k", F.col("v"), most=0).count() == 0


# -- rolling totals


def brute_rolling(daily, periods):
    out = {}
    for s in {k[0] for k in daily}:
        own = {d: v for (x, d), v in daily.items() if x == s}
        for day in range(min(own) + max(periods) - 1, max(own) + 1):
            out[s, day] = tuple((sum(own.get(d, (0, 0))[0] for d in range(day - p + 1, day + 1)), sum(own.get(d, (0, 0))[1] for d in range(day - p + 1, day + 1))) for p in periods)
    return out


@pytest.mark.parametrize("periods", [(7, 30), (1, 100), (3,)])
def test_rolling_and_corrections(spark, periods):
    rng = random.Random(2)
    daily = {(s, d): (float(rng.randint(-5, 50)), rng.randint(1, 3)) for s in (1, 2) for d in rng.sample(range(400), 60 if s == 1 else 3)}
    late = {(1, rng.randint(-40, 500)): (float(rng.randint(1, 9)), 1) for _ in range(12)} | {(3, 5): (1.0, 1)}
    make = lambda m: spark.createDataFrame([(*k, *v) for k, v in m.items()], "series_id BIGINT, day_no BIGINT, total DOUBLE, n BIGINT")
    trees = rolling.build_trees(make(daily))
    corrected = rolling.correct_trees(trees, make(late))
    both = {k: tuple(a + b for a, b in zip(daily.get(k, (0, 0)), late.get(k, (0, 0)))) for k in daily | late}
    for tree, truth in ((trees, daily), (corrected, both)):
        got = {}
        for r in rolling.rolling_totals(tree, periods).collect():
            got[r["series_id"], r["day_no"]] = tuple((r[f"total_{p}"], r[f"n_{p}"]) for p in periods)
            assert all((r[f"mean_{p}"] is None) == (r[f"n_{p}"] == 0) and r[f"per_day_{p}"] == r[f"total_{p}"] / p for p in periods)
        assert got == brute_rolling(truth, periods)


def test_a_correction_touches_only_ancestors(spark):
    daily = spark.createDataFrame([(1, d, 1.0, 1) for d in range(64)], "series_id BIGINT, day_no BIGINT, total DOUBLE, n BIGINT")
    late = spark.createDataFrame([(1, 3, 5.0, 1)], daily.schema)
    before = {r["shard"]: r["sums"] for r in rolling.build_trees(daily).collect()}
    after = {r["shard"]: r["sums"] for r in rolling.correct_trees(rolling.build_trees(daily), late).collect()}
    assert [i for i, (a, b) in enumerate(zip(before[0], after[0])) if a != b] == [1, 2, 4, 8, 17, 35] and before[1] == after[1]


def test_cover_is_exact_and_small():
    for low in range(rolling.SHARD_DAYS):
        for high in range(low, rolling.SHARD_DAYS):
            leaves = []
            for node in rolling.cover(low, high):
                nodes = [node]
                while nodes[0] < rolling.SHARD_DAYS:
                    nodes = [c for n in nodes for c in (2 * n, 2 * n + 1)]
                leaves += [n - rolling.SHARD_DAYS for n in nodes]
            assert sorted(leaves) == list(range(low, high + 1)) and len(rolling.cover(low, high)) <= 8


def test_rolling_edge_cases(spark, make_points):
    points = make_points([(1, 0, 1.0), (1, 29 * DAY, INF), (1, 29 * DAY + 1, None), (1, 31 * DAY, NAN)], noise=True)
    daily = rolling.daily_totals(points)
    rolled = rolling.rolling_totals(rolling.build_trees(daily))
    assert [(r["day_no"], r["total_7"], r["n_30"]) for r in rolled.collect()] == [(29, INF, 2)] and rolling.busy_days(rolled).count() == 0
    assert rolling.rolling_totals(rolling.build_trees(daily.limit(0))).count() == 0
    mixed = rolling.daily_totals(make_points([(1, 0, INF), (1, 29 * DAY, -INF), (1, 30 * DAY, 5.0)]))
    assert rolling.busy_days(rolling.rolling_totals(rolling.build_trees(mixed))).count() == 0


# -- spikes

STEP = 60_000_000_000


def gauge(series, values, step=STEP, start=0):
    return [(series, start + i * step + (i * 7919) % (step // 10), float(v)) for i, v in enumerate(values)]


def gauges(spark, *ids, lo=0.0, hi=100.0):
    return spark.createDataFrame([(i, lo, hi, STEP, 5, "x") for i in ids], "series_id BIGINT, lo DOUBLE, hi DOUBLE, step_ns BIGINT, n INT, shard STRING")


@pytest.mark.parametrize("target_rows", [1 << 16, 150])
def test_spikes_stuck_and_impossible(spark, make_points, monkeypatch, target_rows):
    monkeypatch.setattr(spikes, "plan_shards", lambda *a, **k: shards.plan_shards(*a, **k, target_rows=target_rows))
    monkeypatch.setattr(staging, "LOCAL_INPUT_BYTES", 512 << 20 if target_rows > 150 else -1)
    rng = np.random.default_rng(4)
    n = 1500
    values = 50 + 10 * np.sin(np.arange(n) / 200) + rng.normal(0, 0.3, n)
    values[700:] += 12  # a lasting change of level
    want = {}
    for at, off in ((100, 9), (300, -7), (301, -8), (900, 6), (901, 6), (902, 7)):
        values[at] += off
        want[at] = "rate"
    for at, value in ((500, -3.0), (501, 400.0), (502, INF)):
        values[at] = value
        want[at] = "physical"
    values[1100:1140] = values[1100]
    want |= {i: "stuck" for i in range(1100, 1140)}
    rows = gauge(1, values)
    rows += [(1, rows[10][1], -999.0, -1), (1, rows[20][1], None, -2), rows[30]]
    other = gauge(2, 20 + rng.normal(0, 2, 400))
    found = spikes.implausible(make_points(rows + other), gauges(spark, 1, 2, 3)).collect()
    at = {t: i for i, (_, t, _) in enumerate(gauge(1, values))}
    assert {at[r["ts_ns"]]: r["reason"] for r in found if r["series_id"] == 1} == want
    assert not [r for r in found if r["series_id"] == 2]


def test_spikes_edge_cases(spark, make_points):
    empty = make_points([(1, 1, 1.0)], noise=False).limit(0)
    assert spikes.implausible(empty, gauges(spark, 1)).count() == 0
    constant = gauge(1, [5.0] * 50 + [6.0] + [5.0] * 50)
    reasons = {r["ts_ns"]: r["reason"] for r in spikes.implausible(make_points(constant), gauges(spark, 1)).collect()}
    assert reasons[constant[50][1]] == "rate"
    huge = gauge(1, [1e308, -1e308, 1.7e308, 0.0, 1e-300] * 20)
    wide = gauges(spark, 1, lo=-1.7e308, hi=1.7e308)
    assert spikes.implausible(make_points(huge), wide).where("reason = 'physical'").count() == 0
    unbounded = gauges(spark, 1).selectExpr("series_id", "CAST(NULL AS DOUBLE) lo", "CAST(NULL AS DOUBLE) hi", "step_ns")
    assert [r["reason"] for r in spikes.implausible(make_points([(1, 1, INF), (1, STEP, -5.0)]), unbounded).collect()] == ["physical"]


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    values = np.r_[rng.normal(0, 3, 4000), 0.0, 1e-30]
    df = spark.createDataFrame([(1, 0, float(v)) for v in values], "series_id BIGINT, ts_ns BIGINT, residual DOUBLE")
    parts = [spikes.residual_sketches(df.where(f"pmod(hash(residual), 3) = {i}")) for i in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    q1, q3, n = spikes.sketch_quartiles(merged, "series_id").select("q1", "q3", "n_all").first()
    assert n == len(values) and abs(q1 / np.quantile(values, 0.25) - 1) < 0.03 and abs(q3 / np.quantile(values, 0.75) - 1) < 0.03
    bucket = spikes.sketch_bucket(F.col("residual"))
    worst = df.where("abs(residual) > 1e-9").select(F.max(F.abs(spikes.bucket_middle(bucket) / F.col("residual") - 1))).first()[0]
    assert worst < 0.011


# -- grid


def brute_cell(readings, k, step, bandwidth=grid.BANDWIDTH):
    s0 = s1 = s2 = t0 = t1 = sq = 0.0
    for t, v in readings:
        x = t / step - (k + 0.5)
        w = max(0.0, 1 - abs(x / bandwidth) ** 3) ** 3
        if math.isfinite(v):
            s0, s1, s2, t0, t1, sq = s0 + w, s1 + w * x, s2 + w * x * x, t0 + w * v, t1 + w * x * v, sq + w * w
    if not sq or s0 * s0 / sq < grid.MIN_SUPPORT:
        return None
    spread = s0 * s2 - s1 * s1
    return (s2 * t0 - s1 * t1) / spread if spread > 1e-9 * s0 * s0 else t0 / s0


@pytest.mark.parametrize("cells", [2048, 8])
def test_grid_against_brute_force(spark, make_points, monkeypatch, cells):
    monkeypatch.setattr(grid, "SHARD_CELLS", cells)
    monkeypatch.setattr(staging, "LOCAL_INPUT_BYTES", 512 << 20 if cells > 8 else -1)
    rng = random.Random(6)
    step = 1000
    times = sorted(rng.sample(range(40 * step), 90) + rng.sample(range(300 * step, 340 * step), 30) + [900 * step])
    readings = {1: [(t, rng.random() * 9) for t in times], 2: [(5 * step, 1.0)]}
    readings[1][50] = (readings[1][50][0], INF)
    rows = [(s, t, v) for s, own in readings.items() for t, v in own] + [(1, times[0], 77.0, -1), (1, times[0] - 1, None)]
    described = spark.createDataFrame([(1, step, 3), (2, step, 3), (3, None, 3)], "series_id BIGINT, step_ns BIGINT, n INT")
    got = {(r["series_id"], r["start_ns"]): r for r in grid.regular_grid(make_points(rows), described).collect()}
    want = {(s, k * step): (s, k) for s, own in readings.items() for k in range(own[0][0] // step, own[-1][0] // step + 1)}
    assert set(got) == set(want)
    for key, (s, k) in want.items():
        n = sum(t // step == k for t, _ in readings[s])
        value = brute_cell(readings[s], k, step)
        row = got[key]
        assert row["n_readings"] == n and row["status"] == ("observed" if n else "filled" if value is not None else "missing")
        assert (row["value"] is None) == (value is None) and (value is None or abs(row["value"] - value) < 1e-6)


def test_grid_of_nothing(spark, make_points):
    described = spark.createDataFrame([(1, 10)], "series_id BIGINT, step_ns BIGINT")
    assert grid.regular_grid(make_points([(1, 1, NAN)]), described).count() == 0
    assert grid.regular_grid(make_points([(1, 1, 1.0)], noise=False).limit(0), described).count() == 0
    assert grid.regular_grid(make_points([(1, 1, 1.0)]), described.selectExpr("series_id", "0L AS step_ns")).count() == 0


# -- hot keys


def test_keys(spark):
    points = spark.createDataFrame([(1, 5, 2.0)] * 90 + [(2, 6, None)] * 8 + [(3, 7, NAN), (None, 8, 1.0)], "series_id BIGINT, ts_ns BIGINT, value DOUBLE")
    series = spark.createDataFrame([(1, {"host": "a", "env": "x"}), (2, {"host": "a", "env": None}), (3, None), (1, {"host": "zzz"})], "series_id BIGINT, tags MAP<STRING,STRING>").limit(3)
    keys = spark.createDataFrame([("host",), ("env",), ("host",), (None,)], "key_name STRING")
    states = {(r["key_name"], r["key_value"]): (r["n_rows"], r["n_values"], r["total"], r["first_ns"]) for r in hotkeys.states_by_key(points, series, keys).collect()}
    assert states == {("series_id", "1"): (90, 90, 180.0, 5), ("series_id", "2"): (8, 0, None, 6), ("series_id", "3"): (1, 0, None, 7), ("host", "a"): (98, 90, 180.0, 5), ("env", "x"): (90, 90, 180.0, 5)}
    heavy = {(r["key_name"], r["key_value"]) for r in hotkeys.heavy_keys(points, series, keys).collect()}
    assert heavy == {("series_id", "1"), ("series_id", "2"), ("host", "a"), ("env", "x")}
    assert hotkeys.heavy_keys(points.limit(0), series, keys).count() == 0 and hotkeys.states_by_key(points, series.limit(0), keys.limit(0)).count() == 3


def test_states_merge(spark):
    points = spark.range(100).selectExpr("id % 5 AS series_id", "id AS ts_ns", "double(id) AS value")
    halves = hotkeys.series_states(points.where("ts_ns < 37")).unionByName(hotkeys.series_states(points.where("ts_ns >= 37")))
    assert rows_of(hotkeys.merge_states(halves, "series_id")) == rows_of(hotkeys.series_states(points))
