import random

import numpy as np
import pytest

from chronoloom.llm import percentiles, runs
from chronoloom.operators.staging import staged

INF, NAN = float("inf"), float("nan")


def brute_runs(events, tolerance, anchored, gap):
    out = []
    for t, v in sorted(events):
        last = out[-1] if out else None
        if last:
            reference = last[3] if anchored else last[4]
            if (v == reference or abs(v - reference) <= tolerance) and (gap is None or t - last[1] <= gap):
                last[1], last[2], last[4] = t, last[2] + 1, v
                continue
        out.append([t, t, 1, v, v])
    return sorted(tuple(r[:4]) for r in out)


@pytest.mark.parametrize("compare", ["previous", "anchor"])
@pytest.mark.parametrize("gap", [None, 4])
@pytest.mark.parametrize("target_rows", [1 << 16, 7])
def test_runs_against_brute_force(spark, make_points, compare, gap, target_rows):
    rng = random.Random(7)
    events = {}
    for series in (1, 2, 3):
        t, v = 0, 5.0
        for _ in range(250 if series == 1 else 9):
            t += rng.choice([1, 1, 2, 6])
            v = v + rng.choice([0, 0, 0, 0.4, -0.4, 3, -3]) if series != 2 else 5.0
            events.setdefault(series, []).append((t, v))
    events[3].append((10**6, INF))
    events[3].append((10**6 + 1, INF))
    rows = [(s, t, v) for s, own in events.items() for t, v in own] + [(1, 0, None), (1, events[1][5][0], 99.0, -1)]
    described = spark.createDataFrame([(1, 0.5, 1), (2, None, 1), (3, 0.5, 1), (4, 0.5, 1)], "series_id BIGINT, tolerance DOUBLE, n INT")
    got = runs.collapse_runs(make_points(rows), described, compare=compare, max_gap_ns=gap, target_rows=target_rows).collect()
    for s, own in events.items():
        want = brute_runs(own, 0.5 if s != 2 else 0.0, compare == "anchor", gap)
        assert sorted((r["start_ns"], r["end_ns"], r["n"], r["value"]) for r in got if r["series_id"] == s) == want
    assert all(r["duration_ns"] == r["end_ns"] - r["start_ns"] for r in got)


@pytest.mark.parametrize("kind", ["drift", "walk", "steady", "bursts"])
def test_a_drifting_entity_is_not_one_task(spark, make_points, kind):
    """Anchors over series without a certain break, in many shards."""
    rng = np.random.default_rng(30)
    n = 600
    value = {"drift": np.arange(n) * 0.1, "walk": np.cumsum(rng.normal(0, 0.15, n)), "steady": np.full(n, 5.0), "bursts": np.repeat(rng.normal(0, 0.4, n // 20), 20)}[kind]
    ts = np.cumsum(rng.integers(1, 4, n))
    events = list(zip(ts.tolist(), value.tolist()))
    described = spark.createDataFrame([(1, 0.5)], "series_id BIGINT, tolerance DOUBLE")
    got = runs.collapse_runs(make_points([(1, t, v) for t, v in events]), described, compare="anchor", max_gap_ns=2 if kind == "bursts" else None, target_rows=40).collect()
    assert sorted((r["start_ns"], r["end_ns"], r["n"], r["value"]) for r in got) == brute_runs(events, 0.5, True, 2 if kind == "bursts" else None)


def test_runs_of_nothing(spark, make_points):
    described = spark.createDataFrame([(1, 0.5)], "series_id BIGINT, tolerance DOUBLE")
    assert runs.collapse_runs(make_points([(1, 1, NAN)]), described).count() == 0
    assert runs.collapse_runs(make_points([(1, 1, 1.0)], noise=False).limit(0), described).count() == 0
    assert runs.collapse_runs(make_points([(1, 1, 1.0)]), described.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.collapse_runs(make_points([(1, 1, 1.0)]), described, compare="next")


QS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)


def exact(values, q):
    ordered = sorted(values)
    return ordered[max(1, int(np.ceil(q * len(ordered)))) - 1]


def spread(spark, seed=8):
    rng = random.Random(seed)
    values = {
        1: [rng.gauss(0, 1) for _ in range(3000)],
        2: [-INF] * 400 + [1.0] * 300 + [INF] * 200 + [rng.random() for _ in range(100)],
        3: [5.0],
        4: [rng.choice([1.0, 2.0]) for _ in range(500)],
    }
    df = spark.createDataFrame([(s, v) for s, own in values.items() for v in own] + [(None, 1.0), (1, None), (1, NAN)], "series_id BIGINT, value DOUBLE")
    members = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a"), (1, "all"), (2, "all"), (3, "all"), (4, "all"), (4, "all"), (9, "none"), (None, "a"), (1, None)], "series_id BIGINT, group_id STRING")
    groups = {"a": (1, 4), "b": (2,), "c": (3,), "all": (1, 2, 3, 4)}
    return values, df, members, {g: [v for s in ids for v in values[s]] for g, ids in groups.items()}


@pytest.mark.parametrize("finish", [4096, 3])
def test_multi_select_is_exact(spark, monkeypatch, finish):
    monkeypatch.setattr(percentiles, "FINISH", finish)
    _, df, members, groups = spread(spark)
    pieces = staged(percentiles.value_pieces(df.repartition(5)))
    got = {(r["group_id"], r["percentile"]): (r["value"], r["n"]) for r in percentiles.multi_select(pieces, members, QS).collect()}
    assert got == {(g, q): (exact(own, q), len(own)) for g, own in groups.items() for q in QS}


def test_pieces_of_separate_days_combine_within_the_error_bound(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "FINISH", 3)
    _, df, members, groups = spread(spark)
    days = [percentiles.value_pieces(df.where(f"pmod(hash(value), 3) = {i}")) for i in range(3)]
    pieces = staged(days[0].unionByName(days[1]).unionByName(days[2]))
    for row in percentiles.multi_select(pieces, members, (0.5, 0.9), max_rank_error=0.05).collect():
        own = np.array(groups[row["group_id"]])
        rank = row["percentile"] * len(own)
        below, upto = (own < row["value"]).sum(), (own <= row["value"]).sum()
        assert below - 0.05 * len(own) - 1 <= rank <= upto + 0.05 * len(own) + 1


def test_reading_pieces_take_current_readings_once(spark, make_points):
    points = make_points([(1, 1, 5.0, 1), (1, 1, 7.0, 2), (1, 1, 7.0, 2), (1, 2, None, 1), (1, 3, NAN, 1), (2, 1, 1.0, 1)])
    pieces = percentiles.reading_pieces(points, spark.createDataFrame([(1, 3)], "series_id BIGINT, n INT"))
    assert [(r["series_id"], r["vals"], r["n"]) for r in pieces.collect()] == [(1, [7.0], 1)]


def test_percentiles_of_nothing(spark):
    _, df, members, _ = spread(spark)
    pieces = staged(percentiles.value_pieces(df.limit(0)))
    assert percentiles.multi_select(pieces, members, (0.5,)).count() == 0
    assert percentiles.multi_select(staged(percentiles.value_pieces(df)), members.limit(0), (0.5,)).count() == 0


def test_thin_keeps_weight_and_ranks():
    rng = np.random.default_rng(9)
    values, weights = rng.normal(size=5000), rng.integers(1, 4, 5000).astype(float)
    kept, mass = percentiles.thin(values, weights, 64)
    assert len(kept) == 64 and abs(mass.sum() - weights.sum()) < 1e-6
    for q in (0.1, 0.5, 0.9):
        cut = np.quantile(values, q)
        assert abs(mass[kept <= cut].sum() / mass.sum() - weights[values <= cut].sum() / weights.sum()) < 2 / 64
