import numpy as np

from chronoloom.operators import spikes

STEP = 60_000_000_000


def test_usual_length_is_that_of_all_stretches(spark, make_points):
    """A coarse gauge that keeps each value for 20 to 40 readings, and a long noisy one with one stretch of 9."""
    rng = np.random.default_rng(6)
    coarse = np.concatenate([np.full(n, 30.0 + 2 * (i % 7)) for i, n in enumerate(rng.integers(20, 41, 60))] + [np.full(150, 45.0)])
    noisy = 50 + rng.normal(0, 1, 1200)
    noisy[300:309], noisy[700:712] = noisy[300], noisy[700]
    rows = [(s, i * STEP, float(v)) for s, values in ((1, coarse), (2, noisy)) for i, v in enumerate(values)]
    gauges = spark.createDataFrame([(1, 0.0, 100.0, STEP), (2, 0.0, 100.0, STEP)], "series_id BIGINT, lo DOUBLE, hi DOUBLE, step_ns BIGINT")
    found = spikes.implausible(make_points(rows), gauges).where("reason = 'stuck'").collect()
    assert {r["ts_ns"] // STEP for r in found if r["series_id"] == 1} == set(range(len(coarse) - 150, len(coarse)))
    assert {r["ts_ns"] // STEP for r in found if r["series_id"] == 2} == set(range(700, 712))
