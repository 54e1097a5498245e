import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from chronoloom.operators import buckets, staging


def fold(times, width):
    ends, end = {}, None
    for t in sorted(set(times), reverse=True):
        if end is None or end - t > width:
            end = t
        ends[t] = end
    return ends


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=60), st.integers(0, 40))
def test_ends_equal_the_fold(times, width):
    ts = np.unique(np.array(times))
    got = dict(zip(ts.tolist(), buckets.bucket_ends(ts, width, None).tolist()))
    assert got == fold(times, width)
    ends = sorted(set(got.values()))
    assert all(b - a > width for a, b in zip(ends, ends[1:])) and all(e - t <= width for t, e in got.items())
    exits = buckets.exit_limits(ts, width)
    for t, limit in zip(ts.tolist(), exits.tolist()):
        at = t
        while (older := [x for x in ts.tolist() if x < at - width]) :
            at = max(older)
        assert limit == at - width


@pytest.mark.parametrize("local_bytes, round_entries, streamed", [(512 << 20, 100_000, 10**6), (512 << 20, 100_000, 0), (-1, 100_000, 10), (512 << 20, 1, 10**6), (-1, 1, 0)])
def test_many_shards_per_group(spark, monkeypatch, local_bytes, round_entries, streamed):
    monkeypatch.setattr(buckets, "STREAMED_ENTRIES", streamed)
    monkeypatch.setattr(buckets, "STRETCH_BUCKETS", 3)
    monkeypatch.setattr(staging, "LOCAL_INPUT_BYTES", local_bytes)
    monkeypatch.setattr(buckets, "ROUND_ENTRIES", round_entries)
    rng = np.random.default_rng(3)
    spans = {"hot": (3000, 20_000), "cold": (5, 20_000), "wide": (200, 10**12), "burst": (900, 300)}
    rows = [(g, int(s), int(t), float(v)) for g, (n, span) in spans.items() for s, t, v in zip(rng.integers(0, 3, n), rng.integers(0, span, n), rng.integers(0, 9, n))]
    rows += [("burst", 1, int(t), 1.0) for t in rng.integers(10**6, 10**9, 90)]
    df = spark.createDataFrame(rows + [(None, 1, 1, 1.0), ("hot", 1, 1, None)], "group STRING, series_id BIGINT, ts_ns BIGINT, value DOUBLE")
    for width in (0, 7, 400, 9000) if local_bytes > 0 else (7, 9000):
        got = {(r["group"], r["end"]): (r["start"], r["value"], r["len"]) for r in buckets.bucketed(df, "sum", width, target_rows=100).collect()}
        want = {}
        for g in spans:
            own = [(t, v) for h, _, t, v in rows if h == g]
            ends = fold([t for t, _ in own], width)
            for t, v in own:
                start, total, n = want.get((g, ends[t]), (t, 0.0, 0))
                want[g, ends[t]] = (min(start, t), total + v, n + 1)
        assert got == want


DAY = 86_400_000_000_000


@pytest.mark.parametrize("case", ["stray", "burst", "wide"])
def test_no_shard_is_hot(spark, monkeypatch, case):
    """One stray time, nine rows in ten within an hour, and buckets wider than half of all time."""
    rng = np.random.default_rng(21)
    n, target = 40_000, 2000
    monkeypatch.setattr(buckets, "ROUND_ENTRIES", 100)
    times = 1_700_000_000_000_000_000 + np.sort(rng.choice(58 * 86_400, n, replace=False)) * 1_000_000_000
    if case == "burst":
        times[: n * 9 // 10] = times[-1] + rng.integers(0, 3_600_000_000_000, n * 9 // 10)
    if case == "stray":
        times[0] = 0
    df = spark.createDataFrame([("g", 1, int(t), 1.0) for t in times], "group STRING, series_id BIGINT, ts_ns BIGINT, value DOUBLE")
    rows = df.selectExpr("*", "0L AS ingest_seq", "true AS known")
    _, plan = buckets.plan_groups(rows, target)
    sizes = [r["count"] for r in buckets.located(rows, plan).groupBy("group_no", "shard").count().collect()]
    assert max(sizes) <= 2 * target and len(sizes) >= n / (2 * target)
    width = 30 * DAY if case != "burst" else 600_000_000_000
    got = {r["end"]: r["len"] for r in buckets.bucketed(df, "count", width, target_rows=target).collect()}
    ends = fold(times.tolist(), width)
    want = {}
    for t in times.tolist():
        want[ends[t]] = want.get(ends[t], 0) + 1
    assert got == want


def test_last_writes_and_nan_in_shards(spark):
    nan = float("nan")
    rows = [("g", 1, 5, 1.0, 1), ("g", 1, 5, 2.0, 2), ("g", 1, 5, 2.0, 2), ("g", 2, 5, 7.0, 0), ("g", 1, 6, 3.0, 1), ("g", 1, 6, None, 2), ("g", 1, 7, nan, 1), ("h", 3, 1, nan, 1)]
    df = spark.createDataFrame(rows, "group STRING, series_id BIGINT, ts_ns BIGINT, value DOUBLE, ingest_seq BIGINT")
    got = lambda agg: {r["group"]: (r["start"], r["end"], str(r["value"]), r["len"]) for r in buckets.bucketed(df, agg, 10, writes=True).collect()}
    assert got("max") == {"g": (5, 7, "7.0", 3), "h": (1, 1, "nan", 1)} and got("min")["g"][2] == "2.0" and got("sum")["g"][2] == "nan"


def test_empty_and_huge_width(spark):
    df = spark.createDataFrame([], "group STRING, series_id BIGINT, ts_ns BIGINT, value DOUBLE")
    assert buckets.bucketed(df, "avg", 5).count() == 0
    df = spark.createDataFrame([("g", 1, 0, 1.0), ("g", 1, 2**62, 1.0)], df.schema)
    assert [r["len"] for r in buckets.bucketed(df, "avg", 2**62).collect()] == [2]
    assert sorted(r["len"] for r in buckets.bucketed(df, "avg", 2**61).collect()) == [1, 1]


def historical(rows, width, drop, by_series):
    """(newest time, oldest time, total, number) of the buckets, row by row. rows: (series, ts, value)."""
    newest = {}
    for s, t, _ in rows:
        newest[s] = max(t, newest.get(s, t))
    order = sorted(rows, key=lambda r: (newest[r[0]], r[0], -r[1], r[2]) if by_series else (-r[1], r[2]))
    found, open_ = [], None
    for _, t, v in order:
        if open_ and (t > open_[0] or open_[0] - t > width):
            found.append(tuple(open_))
            open_ = None
            if drop:
                continue
        if open_ is None:
            open_ = [t, t, 0.0, 0]
        open_ = [open_[0], t, open_[2] + v, open_[3] + 1]
    return sorted(found + ([tuple(open_)] if open_ else []))


@pytest.mark.parametrize("round_entries, streamed", [(1, 10**6), (100_000, 10**6), (100_000, 0)])
def test_losses_across_shards_equal_the_fold(spark, monkeypatch, round_entries, streamed):
    monkeypatch.setattr(buckets, "STREAMED_ENTRIES", streamed)
    monkeypatch.setattr(buckets, "STRETCH_BUCKETS", 2)
    """Ties, limits and lost points at the borders of many small shards."""
    monkeypatch.setattr(buckets, "ROUND_ENTRIES", round_entries)
    rng = np.random.default_rng(15)
    rows = {g: [(int(s), int(t), float(rng.integers(0, 9))) for s, t in zip(rng.integers(0, 4, n), rng.integers(0, span, n))] for g, n, span in (("x", 400, 900), ("y", 300, 10**6), ("z", 3, 5))}
    df = spark.createDataFrame([(g, *r) for g, own in rows.items() for r in own], "group STRING, series_id BIGINT, ts_ns BIGINT, value DOUBLE")
    for width in (0, 11, 300, 40_000):
        got = buckets.bucketed(df, "sum", width, boundary="drop", target_rows=30).collect()
        for g, own in rows.items():
            assert sorted((r["end"], r["start"], r["value"], r["len"]) for r in got if r["group"] == g) == historical(own, width, True, False), (width, g)


@pytest.mark.parametrize("drop", [False, True])
@pytest.mark.parametrize("by_series", [False, True])
def test_historical_modes_equal_the_fold(spark, drop, by_series):
    rng = np.random.default_rng(13)
    rows = {g: [(s, int(t), float(rng.integers(0, 9))) for s in range(3) for t in rng.choice(1000, 60, replace=False)] for g in ("x", "y")}
    df = spark.createDataFrame([(g, *r) for g, own in rows.items() for r in own], "group STRING, series_id BIGINT, ts_ns BIGINT, value DOUBLE")
    got = buckets.bucketed(df, "sum", 25, boundary="drop" if drop else "keep", order="series" if by_series else "time").collect()
    for g, own in rows.items():
        assert sorted((r["end"], r["start"], r["value"], r["len"]) for r in got if r["group"] == g) == historical(own, 25, drop, by_series)
