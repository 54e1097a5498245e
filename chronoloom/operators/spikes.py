"""Implausible readings: spikes, stuck values and physically impossible values, judged per series.

A reading's residual is its distance from the median of the readings around it. Residuals go into
log-scaled quantile sketches per series and hour of day: bucket counts, which merge by addition across
partitions, shards and days. Fences are quartiles of the merged sketch expanded by a multiple of the
interquartile range, with the hour's own range where the hour is noisier than the series.

A reading is flagged

* ``physical`` if it lies outside the metric's bounds (infinite values included),
* ``rate`` if it lies outside the fences around its neighbourhood and has jumped to the same side from the
  median of the readings before it and from that of the readings after it: an excursion and back, which a
  lasting change of level, a trend or a daily cycle is not,
* ``stuck`` if it belongs to a stretch of near-zero variance far longer than the series' other ones. Readings more
  than ``HALO_STEPS`` nominal steps apart are in different stretches.

Null and NaN values are no readings. Readings repeated at one time count once (see ``shards.latest``).
Series without bounds (null ``lo``/``hi``) have no physical cases.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronoloom.operators.shards import latest, plan_shards, sharded, starts_of, valid_points, whole_shards
from chronoloom.operators.staging import dimension, join_dimension, staged

#: Readings looked at on either side; a brief excursion must be shorter than half of it.
SIDE = 8
#: How far, in nominal steps, those readings may lie away.
HALO_STEPS = 64
#: Multiple of the interquartile range beyond the quartiles at which a residual is implausible.
FENCE = 4.2
#: Share of the residual that the distance from either side's median must reach.
BOTH_SIDES = 0.6
#: Relative width of a sketch bucket.
GROWTH = 1.02
#: Hours with fewer readings than this take the fences of the whole series.
HOUR_READINGS = 200
#: A step of a stuck stretch is at most this share of the interquartile range.
STILL = 0.005
#: Readings of a stuck stretch at least, and how many times the series' other stretches it must be.
STUCK_READINGS = 10
STUCK_TIMES = 2.0
#: Which quantile of a series' stretches is its usual one, and how many of the longest are left out at least.
USUAL = 0.99
OWN = 2

FEATURES = (
    "series_id bigint, shard bigint, ts_ns bigint, prev_ns bigint, value double, prev double, residual double, "
    "off_left double, off_right double, lo double, hi double, carried boolean"
)


def _side_median(value: np.ndarray, ts: np.ndarray, usable: np.ndarray, first: np.ndarray, reach: np.ndarray, after: bool) -> np.ndarray:
    """Median of up to ``SIDE`` usable readings before (after) each reading; NaN with fewer than two."""
    if after:
        return _side_median(value[::-1], -ts[::-1], usable[::-1], np.r_[first[1:], True][::-1], reach[::-1], False)[::-1]
    n = len(value)
    group = np.cumsum(first)
    near = np.full((n, SIDE), np.inf)
    for k in range(1, SIDE + 1):
        ok = usable[:-k] & (group[:-k] == group[k:]) & (ts[k:] - ts[:-k] <= reach[k:])
        near[k:, k - 1][ok] = value[:-k][ok]
    near.sort(axis=1)
    count = np.isfinite(near).sum(axis=1)
    row = np.arange(n)
    with np.errstate(invalid="ignore"):
        middle = (near[row, np.maximum(count - 1, 0) // 2] + near[row, np.minimum(count // 2, SIDE - 1)]) / 2
    return np.where(count >= 2, middle, np.nan)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for raw in whole_shards(batches):
        block = latest(raw)
        ts, value = block["ts_ns"], block["value"]
        if not len(ts):
            continue
        first = starts_of(block["series_id"], block["shard"])
        possible = np.isfinite(value) & ~(value < block["lo"]) & ~(value > block["hi"])
        left = _side_median(value, ts, possible, first, block["halo_ns"], False)
        right = _side_median(value, ts, possible, first, block["halo_ns"], True)
        with np.errstate(invalid="ignore", over="ignore"):
            centre = np.where(np.isnan(left), right, np.where(np.isnan(right), left, (left + right) / 2))
            before, prev = np.r_[np.nan, value[:-1]], np.r_[-1, ts[:-1]]
            # a stretch does not go on over a gap wider than the halo, wherever shards begin
            alone = first | (ts - prev > block["halo_ns"])
            before[alone], prev[alone] = np.nan, -1
            residual = value - centre
            residual[~possible | ~np.isfinite(residual)] = np.nan
            off_left, off_right = value - left, value - right
        own = (ts >= block["shard"]) & (ts < block["end_ns"])
        carried = (prev >= 0) & (prev < block["shard"])
        columns = [block["series_id"], block["shard"], ts, prev, value, before, residual, off_left, off_right, block["lo"], block["hi"], carried]
        # NaN in these columns means "none"
        yield pa.RecordBatch.from_arrays([pa.array(c[own], from_pandas=c.dtype == float) for c in columns], [x.split()[0] for x in FEATURES.split(", ")])


def reading_features(points: DataFrame, gauges: DataFrame) -> DataFrame:
    """One row per reading of the gauges with the value before it, its residual and distance from either side's median.

    ``gauges`` has ``series_id, lo, hi, step_ns``. One shuffle of the points by (series, time shard); the
    shards carry a halo of ``HALO_STEPS`` steps.
    """
    known = gauges.select("series_id", F.col("lo").cast("double"), F.col("hi").cast("double"), "step_ns")
    plan = plan_shards(valid_points(points), known, step="step_ns", halo_steps=HALO_STEPS)
    return sharded(points, plan, ["lo", "hi", "halo_ns"], halo=True).mapInArrow(_features, FEATURES)


def sketch_bucket(value: Column, growth: float = GROWTH) -> Column:
    """Bucket number of a residual: symmetric, logarithmic above 2^-40, so relative error is bounded."""
    scaled = F.ceil((F.log(F.abs(value)) + 40 * float(np.log(2))) / float(np.log(growth)))
    return F.when(F.abs(value) <= float(2.0**-40), F.lit(0)).otherwise(F.signum(value) * F.greatest(scaled, F.lit(1))).cast("int")


def bucket_middle(bucket: Column, growth: float = GROWTH) -> Column:
    """The value a bucket stands for."""
    size = F.pow(F.lit(growth), F.abs(bucket) - F.lit(0.5)) / float(2**40)
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)


def residual_sketches(features: DataFrame) -> DataFrame:
    """Mergeable sketch rows ``series_id, hour, bucket, n`` of the residuals (UTC hour of day)."""
    hour = F.expr("cast((ts_ns div 3600000000000) % 24 as int)").alias("hour")
    bucket = sketch_bucket(F.col("residual")).alias("bucket")
    return features.where("residual IS NOT NULL").groupBy("series_id", hour, bucket).agg(F.count("*").alias("n"))


def sketch_quartiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """``q1, q3, n_all`` per key from merged sketches. Windows run over buckets, whose number is bounded."""
    merged = sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    up = W.partitionBy(*keys).orderBy("bucket")
    whole = W.partitionBy(*keys)
    counted = merged.withColumn("below", F.sum("n").over(up)).withColumn("n_all", F.sum("n").over(whole))
    value = bucket_middle(F.col("bucket"))
    return counted.groupBy(*keys).agg(
        F.min(F.when(F.col("below") * 4 >= F.col("n_all"), value)).alias("q1"),
        F.min(F.when(F.col("below") * 4 >= F.col("n_all") * 3, value)).alias("q3"),
        F.max("n_all").alias("n_all"),
    )


def fences(sketches: DataFrame) -> DataFrame:
    """``series_id, hour, iqr, series_iqr``: the range used for each hour that has readings.

    The hour's own range counts where it is the larger one and rests on ``HOUR_READINGS`` readings.
    """
    series = sketch_quartiles(sketches, "series_id").select("series_id", (F.col("q3") - F.col("q1")).alias("series_iqr"))
    hours = sketch_quartiles(sketches, "series_id", "hour").select("series_id", "hour", (F.col("q3") - F.col("q1")).alias("hour_iqr"), "n_all")
    own = F.when(F.col("n_all") >= HOUR_READINGS, F.col("hour_iqr"))
    return hours.join(series, "series_id").select("series_id", "hour", F.greatest(own, "series_iqr").alias("iqr"), "series_iqr")


def still_parts(still: DataFrame) -> DataFrame:
    """Parts of stretches chained by small steps: ``series_id, shard, start_ns, start, end_ns, carried, run, n``.

    ``still`` has ``series_id, shard, ts_ns, prev_ns, prev, carried`` of the readings whose step from the one
    before (at ``prev_ns``; ``carried``: in an earlier shard) is small. Chains are built within shards.
    Only the few parts that meet at a shard border are stitched over a whole series; ``run`` numbers the
    stretches of a series and ``n`` is the readings of the whole stretch.
    """
    within = W.partitionBy("series_id", "shard").orderBy("ts_ns")
    numbered = still.withColumn("fresh", (~F.lag("ts_ns").over(within).eqNullSafe(F.col("prev_ns"))).cast("int")).withColumn("chain", F.sum("fresh").over(within))
    parts = staged(
        numbered.groupBy("series_id", "shard", "chain").agg(
            F.min("prev_ns").alias("start_ns"), F.min_by("prev", "prev_ns").alias("start"), F.max("ts_ns").alias("end_ns"),
            F.count("*").alias("steps"), F.max("carried").alias("carried"),
        )
    )
    met = parts.where("carried").select("series_id", F.col("start_ns").alias("end_ns"), F.lit(True).alias("goes_on"))
    marked = parts.join(met, ["series_id", "end_ns"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    across = W.partitionBy("series_id").orderBy("start_ns")
    border = (
        marked.where("carried OR goes_on")
        .withColumn("run", F.sum((~F.lag("end_ns").over(across).eqNullSafe(F.col("start_ns"))).cast("int")).over(across))
        .withColumn("n", F.sum("steps").over(W.partitionBy("series_id", "run")) + 1)
    )
    inner = marked.where("NOT carried AND NOT goes_on").withColumn("run", F.lit(None).cast("long")).withColumn("n", F.col("steps") + 1)
    return border.unionByName(inner).select("series_id", "shard", "start_ns", "start", "end_ns", "carried", "run", "n")


def usual_stretches(parts: DataFrame, readings: DataFrame) -> DataFrame:
    """``series_id, usual``: the ``USUAL`` quantile of the lengths of all stretches of each series.

    ``readings`` has ``series_id, n_readings``. A reading that repeats none is a stretch of 1. Lengths are counted per
    series, which merges by addition; the ``OWN`` longest are left out, so that in a series of few stretches a stuck
    one is not its own measure.
    """
    whole = parts.where("run IS NULL").select("series_id", "n").unionByName(parts.where("run IS NOT NULL").select("series_id", "run", "n").distinct().drop("run"))
    counts = whole.groupBy("series_id", "n").agg(F.count("*").alias("times"))
    held = counts.groupBy("series_id").agg(F.sum(F.col("n") * F.col("times")).alias("held"))
    single = readings.join(held, "series_id", "left").select("series_id", F.lit(1).cast("long").alias("n"), (F.col("n_readings") - F.coalesce("held", F.lit(0))).alias("times"))
    up = W.partitionBy("series_id").orderBy("n")
    ranked = counts.unionByName(single).withColumn("upto", F.sum("times").over(up)).withColumn("all", F.sum("times").over(W.partitionBy("series_id")))
    rank = F.least(F.ceil(F.col("all") * USUAL), F.col("all") - OWN)
    return ranked.groupBy("series_id").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.greatest(rank, F.lit(1)), F.col("n"))), F.lit(1)).alias("usual"))


def stuck_parts(parts: DataFrame, readings: DataFrame) -> DataFrame:
    """The parts whose stretch is far longer than the series otherwise keeps a value (:func:`usual_stretches`)."""
    candidates = parts.where(F.col("n") >= STUCK_READINGS)
    usual = usual_stretches(parts, readings)
    return join_dimension(candidates, dimension(usual), "series_id", F.col("start_ns")).where(F.col("n") >= F.col("usual") * STUCK_TIMES)


def implausible(points: DataFrame, gauges: DataFrame) -> DataFrame:
    """Flagged readings ``series_id, ts_ns, value, reason``, each reading once.

    Where several reasons hold, the first of physical, rate, stuck is given. ``points`` are stored points,
    ``gauges`` the columns ``series_id, lo, hi, step_ns``; a gauge without a positive step is left out.
    """
    features = staged(reading_features(points, gauges))
    ranges = staged(fences(residual_sketches(features)))
    hour = F.expr("cast((ts_ns div 3600000000000) % 24 as int)")
    judged = join_dimension(features.withColumn("hour", hour), ranges, ["series_id", "hour"], F.col("ts_ns"), "left")
    impossible = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")) | (F.abs("value") == float("inf"))
    # the quartiles of residuals lie about half a range from zero
    limit = F.col("iqr") * (FENCE + 0.5)
    left, right = F.coalesce("off_left", "off_right"), F.coalesce("off_right", "off_left")
    middle = (left + right) / 2
    away = (F.abs(middle) > limit) & (F.least(left * F.signum(middle), right * F.signum(middle)) > F.abs(middle) * BOTH_SIDES)
    alone = judged.withColumn("reason", F.when(F.coalesce(impossible, F.lit(False)), "physical").when(F.coalesce(away, F.lit(False)), "rate"))
    single = alone.where("reason IS NOT NULL").select("series_id", "ts_ns", "value", "reason")

    still = judged.where(F.abs(F.col("value") - F.col("prev")) <= F.col("series_iqr") * STILL).select("series_id", "shard", "ts_ns", "prev_ns", "prev", "carried")
    readings = features.groupBy("series_id").agg(F.count("*").alias("n_readings"))
    stuck = stuck_parts(staged(still_parts(still)), readings)
    return single.unionByName(_members(features, stuck)).groupBy("series_id", "ts_ns").agg(
        F.max("value").alias("value"), F.min_by("reason", F.when(F.col("reason") == "physical", 0).when(F.col("reason") == "rate", 1).otherwise(2)).alias("reason")
    )


def _members(features: DataFrame, stuck: DataFrame) -> DataFrame:
    """The readings inside stuck stretches, matched shard by shard: a shard has a bounded number of parts.

    The first reading of a carried part lies in an earlier shard; the part itself has its time and value.
    """
    spans = dimension(stuck.groupBy("series_id", "shard").agg(F.collect_list(F.struct("start_ns", "end_ns")).alias("spans")))
    inside = F.exists("spans", lambda s: (F.col("ts_ns") >= s["start_ns"]) & (F.col("ts_ns") <= s["end_ns"]))
    reason = F.lit("stuck").alias("reason")
    within = join_dimension(features, spans, ["series_id", "shard"], F.col("ts_ns")).where(inside).select("series_id", "ts_ns", "value", reason)
    return within.unionByName(stuck.where("carried").select("series_id", F.col("start_ns").alias("ts_ns"), F.col("start").alias("value"), reason))
