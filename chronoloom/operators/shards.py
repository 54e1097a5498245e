"""Readings cut into time shards: the unit in which series are processed.

A series may hold a third of all rows, and most of them within an hour, so no operator works on a whole
series in one task. Rows are counted first and a series is cut into slices of time that hold about
``target_rows`` rows each, narrow ones where its rows lie close. A slice can carry a halo: the rows just
outside it that its neighbourhoods need.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.operators.staging import dimension, join_dimension, known_rows, with_known_rows

#: Rows of a shard that are aimed at.
TARGET_ROWS = 1 << 16
#: Rows gathered before a batch of whole shards is handed to the vectorised code.
BATCH_ROWS = 1 << 16
#: The last time there can be.
LAST_NS = (1 << 63) - 1


def valid_points(points: DataFrame) -> DataFrame:
    """The four columns of stored points, without rows that have no identity.

    Rows whose ``series_id`` or ``ts_ns`` is null or whose ``ts_ns`` is negative belong to no reading.
    """
    return points.select(
        F.col("series_id").cast("long").alias("series_id"),
        F.col("ts_ns").cast("long").alias("ts_ns"),
        F.col("value").cast("double").alias("value"),
        F.col("ingest_seq").cast("long").alias("ingest_seq"),
    ).where("series_id IS NOT NULL AND ts_ns >= 0")


def kind_of_series(series: DataFrame, metric_info: DataFrame, kind: str) -> DataFrame:
    """``series_id, metric`` and the properties of ``metric_info`` for the series of one kind.

    ``metric_info`` has a fixed handful of rows; a metric or series listed twice counts once.
    """
    wanted = [c for c in ("metric", "lo", "hi", "step_ns", "tolerance") if c in metric_info.columns]
    info = metric_info.where(F.col("kind") == kind).dropDuplicates(["metric"]).select(*wanted)
    ids = series.select("series_id", "metric").where("series_id IS NOT NULL").dropDuplicates(["series_id"])
    return ids.join(info, "metric")


@dataclass(frozen=True)
class ShardPlan:
    """How each key (a series or a group) is cut into shards.

    ``keys`` has one row per key: its described columns and ``origin_ns, last_ns, width_ns, halo_ns, recut``. A key's
    shards are slices of ``width_ns`` from its origin, but those that hold too many rows, where time is unevenly
    filled, are cut again: ``recut[k]`` lists them by (key, begin) with the width ``finer_ns`` of their parts, which may
    be listed in ``recut[k + 1]``. Only overfull shards are listed, so a key that is evenly filled needs none.
    """

    key: str
    keys: DataFrame
    recut: tuple[DataFrame, ...]


def plan_shards(
    points: DataFrame,
    described: DataFrame | None = None,
    *,
    key: str = "series_id",
    step: str | None = None,
    halo_steps: int = 0,
    target_rows: int = TARGET_ROWS,
    most_steps: int | None = None,
) -> ShardPlan:
    """Cut each key of ``described`` (default: of ``points``) so that a shard holds about ``target_rows`` rows.

    ``points`` has ``key`` and ``ts_ns`` (neither null nor negative). Counting is a native aggregate with map-side
    combining over these two columns. ``step`` names a column of ``described`` whose multiple every width shall be (the
    origin then lies on the grid of steps), ``most_steps`` bounds the steps of a shard, and the halo is ``halo_steps``
    steps (a shard is at least twice as wide, and holds more rows only where that many lie within so little time).
    Keys of one shard are counted once. The others are counted by shard, and only the rows of overfull shards by
    their parts, until none has more than twice ``target_rows``; a stray time far away costs one more count of its key.
    """
    rows = points.select(key, "ts_ns")
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
    known = counted if described is None else (described.where(f"{step} > 0") if step else described).join(counted, key)
    unit = F.col(step) if step else F.lit(1)
    least = max(2 * halo_steps, 1)

    def steps(extent: Column) -> Column:
        """Steps of a slice when ``n`` rows lie over ``extent`` nanoseconds."""
        spread = F.floor(F.least(F.lit(2.0**62), extent / F.ceil(F.col("n") / F.lit(target_rows))) / unit) + 1
        return F.greatest(F.lit(least), spread if most_steps is None else F.least(F.lit(max(most_steps, least)), spread))

    keys = dimension(
        known.withColumn("origin_ns", F.expr(f"first_ns - first_ns % {step}") if step else F.col("first_ns"))
        .withColumn("width_ns", (steps(F.col("last_ns") - F.col("first_ns")) * unit).cast("long"))
        .withColumn("least_ns", (F.lit(least) * unit).cast("long"))
        .withColumn("halo_ns", (F.lit(halo_steps) * unit).cast("long"))
    )
    several = keys.where("n > 0 AND last_ns - origin_ns >= width_ns")
    cut: list[DataFrame] = []
    if several.limit(1).count():
        slim = dimension(several.select(key, "origin_ns", "width_ns", "least_ns", unit.cast("long").alias("unit_ns")))
        at = _slices(join_dimension(rows, slim, key, F.col("ts_ns")))
        while True:
            cells = at.groupBy(key, "begin_ns", "end_ns", "least_ns", "unit_ns").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
            spread = F.floor((F.col("last_ns") - F.col("first_ns")) / F.ceil(F.col("n") / F.lit(target_rows)) / F.col("unit_ns")).cast("long") + 1
            finer = F.greatest(F.col("least_ns"), spread * F.col("unit_ns"))
            over = cells.where(F.col("n") > 2 * target_rows).withColumn("finer_ns", finer).where("finer_ns <= (end_ns - begin_ns) div 2")
            over = dimension(over.select(key, "begin_ns", "finer_ns"))
            if not over.limit(1).count():
                break
            cut.append(over)
            at = _again(join_dimension(at, over, [key, "begin_ns"], F.col("ts_ns")))
    if cut:
        named = cut[0].select(key).distinct().withColumn("recut", F.lit(True))
        keys = dimension(keys.join(named, key, "left").withColumn("recut", F.coalesce("recut", F.lit(False))))
    else:
        keys = with_known_rows(keys.select("*", F.lit(False).alias("recut")), known_rows(keys))
    return ShardPlan(key, with_known_rows(keys.drop("n", "first_ns", "least_ns"), known_rows(keys)), tuple(cut))


def _begin(time: str) -> str:
    return f"origin_ns + ({time} - origin_ns) div width_ns * width_ns"


def _slices(rows: DataFrame, time: str = "ts_ns") -> DataFrame:
    """Add ``begin_ns, end_ns`` of the slice of each row's time; the last one may end at the last time there is."""
    return rows.withColumn("begin_ns", F.expr(_begin(time))).withColumn("end_ns", F.expr(f"coalesce(try_add(begin_ns, width_ns), {LAST_NS})"))


def _part(time: str) -> str:
    """Begin of the part of a shard that is cut again; what is left over at its end belongs to the last part."""
    return f"begin_ns + least(({time} - begin_ns) div finer_ns, (end_ns - begin_ns) div finer_ns - 1) * finer_ns"


def _again(rows: DataFrame, time: str = "ts_ns") -> DataFrame:
    """Replace ``begin_ns, end_ns`` by those of the part where ``finer_ns`` is known."""
    part, last = F.expr(_part(time)), F.expr(f"({time} - begin_ns) div finer_ns >= (end_ns - begin_ns) div finer_ns - 1")
    ends = F.when(last, F.col("end_ns")).otherwise(part + F.col("finer_ns"))
    cut = F.col("finer_ns").isNotNull()
    return rows.withColumns({"begin_ns": F.when(cut, part).otherwise(F.col("begin_ns")), "end_ns": F.when(cut, ends).otherwise(F.col("end_ns"))}).drop("finer_ns")


def located(rows: DataFrame, plan: ShardPlan, halo: bool = False) -> DataFrame:
    """Rows of the planned keys with the plan's columns, ``shard`` (the time at which it begins) and ``end_ns``.

    With ``halo`` a row also goes to the shards before and behind its own that it is within the halo of. Shards are
    at least as wide as the halo, so these are the ones of the times a halo before and after it.
    """
    key = plan.key
    met = join_dimension(rows, plan.keys, key, F.col("ts_ns"))
    if not halo:
        met = _slices(met)
        for finer in plan.recut:
            met = _again(join_dimension(met, finer, [key, "begin_ns"], F.col("ts_ns"), "left"))
        return met.withColumnRenamed("begin_ns", "shard")
    low, high = "greatest(ts_ns - halo_ns, origin_ns)", "least(coalesce(try_add(ts_ns, halo_ns), ts_ns), last_ns)"
    own = _begin("ts_ns")
    near = F.expr(
        f"array_compact(array(if({low} < ts_ns AND (recut OR {_begin(low)} < {own}), {low}, null), ts_ns, if({high} > ts_ns AND (recut OR {_begin(high)} > {own}), {high}, null)))"
    )
    met = _slices(met.withColumn("own_ns", F.expr(own)).withColumn("near_ns", F.explode(near)), "near_ns")
    for finer in plan.recut:
        met = join_dimension(met, finer, [key, "begin_ns"], F.col("ts_ns"), "left")
        same = F.col("finer_ns").isNotNull() & (F.col("own_ns") == F.col("begin_ns"))
        met = _again(met.withColumn("own_ns", F.when(same, F.expr(_part("ts_ns"))).otherwise(F.col("own_ns"))), "near_ns")
    met = met.where("near_ns = ts_ns OR begin_ns <> own_ns")
    return met.drop("own_ns", "near_ns").withColumnRenamed("begin_ns", "shard")


def sharded(points: DataFrame, plan: ShardPlan, extras: list[str], halo: bool = False) -> DataFrame:
    """Stored points of the planned series with ``shard``, all rows of a shard together and in order.

    Columns: ``series_id, shard, ts_ns, value, ingest_seq, end_ns`` and ``extras`` of the plan. One shuffle, on
    (series, shard); order within it (series_id, shard, ts_ns, ingest_seq, value).
    """
    return (
        located(valid_points(points), plan, halo)
        .select("series_id", "shard", "ts_ns", "value", "ingest_seq", "end_ns", *extras)
        .repartition("series_id", "shard")
        .sortWithinPartitions("series_id", "shard", "ts_ns", "ingest_seq", "value")
    )


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    out = {}
    for name in table.column_names:
        column = table.column(name)
        if pa.types.is_floating(column.type):
            out[name] = column.to_numpy()  # nulls become NaN
        else:
            out[name] = (column.fill_null(0) if column.null_count else column).to_numpy()
    return out


def whole_shards(
    batches: Iterable[pa.RecordBatch], least: int = BATCH_ROWS, keys: tuple[str, str] = ("series_id", "shard")
) -> Iterator[dict[str, np.ndarray]]:
    """Regroup sorted Arrow batches into batches of whole shards (rows of equal ``keys``), as NumPy columns.

    Whatever the sizes of the incoming batches, a shard is never cut. A shard larger than ``least`` is
    gathered by doubling, so the copying stays linear.
    """
    held: list[pa.RecordBatch] = []
    rows, wanted = 0, least
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        series, shard = (table.column(c).to_numpy() for c in keys)
        other = np.flatnonzero((series != series[-1]) | (shard != shard[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if not cut:
            wanted = 2 * rows
            held = table.to_batches()
            continue
        yield _columns(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
        rows, wanted = table.num_rows - cut, max(least, 2 * (table.num_rows - cut))
    if rows:
        yield _columns(pa.Table.from_batches(held))


def latest(block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Keep of each (series, shard, ts) the last row in order, then leave out null and NaN values.

    In sorted order the last row is the one with the highest ``ingest_seq``; of rows equal in that too
    (repeats) it is the one with the greatest value, NaN counting as greatest and null as least.
    """
    series, shard, ts = block["series_id"], block["shard"], block["ts_ns"]
    last = np.ones(len(ts), dtype=bool)
    last[:-1] = (series[1:] != series[:-1]) | (shard[1:] != shard[:-1]) | (ts[1:] != ts[:-1])
    keep = last & ~np.isnan(block["value"])
    return {name: column[keep] for name, column in block.items()}


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Mark the first row of each run of equal keys."""
    first = np.ones(len(columns[0]), dtype=bool)
    if len(first):
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first


def current_readings(points: DataFrame, described: DataFrame) -> DataFrame:
    """``series_id, ts_ns, value`` of the readings of the described series, by native aggregates alone.

    The highest ``ingest_seq`` wins; ties take the greatest value. Partial aggregation removes repeats
    before the shuffle.
    """
    ids = dimension(described.select("series_id"))
    chosen = join_dimension(valid_points(points), ids, "series_id", F.col("ts_ns"))
    return (
        chosen.groupBy("series_id", "ts_ns")
        .agg(F.max(F.struct("ingest_seq", "value")).getField("value").alias("value"))
        .where("value IS NOT NULL AND NOT isnan(value)")
    )
