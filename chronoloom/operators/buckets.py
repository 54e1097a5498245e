"""Time buckets anchored on their newest point.

Within a group, from the newest point back, a point joins the open bucket while it is at most ``width`` older
than the bucket's newest point; the first one that is older opens the next bucket. So the ends of the buckets
are the orbit of ``e -> newest time before e - width``, which no fixed window expresses.

A group is cut into shards of about equal rows, whatever the width of a bucket. One
shuffle on (group, shard) serves the last write of each series and time, the order and the buckets, of which
only partial aggregates leave a shard. The orbit enters a shard at a limit handed on by a newer one: each shard
of a group that has several states at which limit the orbit leaves it for every time at which it could enter.
Where these tables are small beside the rows (buckets much narrower than shards) one pass follows them shard by
shard, in a large group after the tables of long stretches have been merged in parallel. Where they are not (a bucket covers many shards) there are few buckets: then the limits are found in
rounds, each of which looks up one shard per group, and the shards in between, which lie in one bucket, are
not looked at. Groups of one shard skip all that.

``boundary="drop"`` loses the point that closes a bucket; of points of one time the one with the least value closes it.
``order="series"`` reads the series of a group one after the other, the one whose newest point is oldest first. It
follows single rows and streams a group through one task in constant memory; it exists for comparison with the
historical behaviour.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronoloom.errors import InvalidQuery
from chronoloom.operators.shards import TARGET_ROWS, ShardPlan, located, plan_shards, starts_of, whole_shards
from chronoloom.operators.staging import dimension, join_dimension, known_rows, staged, with_known_rows

AGGREGATES = ("avg", "sum", "min", "max", "count")
_KEYS = ("group_no", "shard")
#: A round of looking up costs about as much as following so many entries of tables.
ROUND_ENTRIES = 100_000
#: Entries of a group's tables that one task follows; beyond, and so many bucket widths long, stretches are followed.
STREAMED_ENTRIES, STRETCH_BUCKETS = 4_000_000, 64
#: What stands for "no limit".
_NO_LIMIT = -(1 << 63)

_TABLES = "group_no bigint, shard bigint, oldest bigint, n_entries bigint, top bigint, entries array<bigint>, exits array<bigint>"
_PARTIAL = "group_no bigint, bucket_end bigint, start bigint, len bigint, total double, least double, most double"


def aggregate(name: str, value: str = "value") -> Column:
    """The value of a bucket. ``min`` and ``max`` ignore NaN unless there is nothing else; ``count`` is a float."""
    column = F.col(value)
    known = F.when(~F.isnan(column), column)
    if name == "count":
        return F.count(F.lit(1)).cast("double")
    if name in ("min", "max"):
        return F.coalesce(getattr(F, name)(known), F.max(column))
    if name in ("avg", "sum"):
        return getattr(F, name)(column)
    raise InvalidQuery(f"unknown aggregate {name!r}; known are {', '.join(AGGREGATES)}")


def _next(ts: np.ndarray, width: int) -> np.ndarray:
    """For ascending times, the index of the newest time before ``ts - width`` (-1: none)."""
    return np.searchsorted(ts, ts - width, "left") - 1


def exit_limits(ts: np.ndarray, width: int, drop: bool = False) -> np.ndarray:
    """The limit at which the orbit leaves the shard, for each time as the first bucket end in it.

    With ``drop`` the point behind a bucket is lost and the one after it opens the next; ``_NO_LIMIT`` says that the
    last point of the shard was lost, so that an older shard's newest point opens a bucket.
    """
    after = _next(ts, width)
    lost = drop & (after == 0)
    last = np.where((after < 0) | lost, np.arange(len(ts)), after - drop)
    while True:  # pointer doubling
        further = last[last]
        if np.array_equal(further, last):
            return np.where(lost[last], _NO_LIMIT, ts[last] - width)
        last = further


def bucket_ends(ts: np.ndarray, width: int, limit: int | None) -> np.ndarray:
    """The newest time of the bucket of each of the ascending distinct times.

    ``limit`` says that a newer shard's bucket takes in all times from ``limit`` on (its newest time is
    ``limit + width``).
    """
    if not len(ts):
        return ts
    after = _next(ts, width)
    at = len(ts) - 1 if limit is None else int(np.searchsorted(ts, limit, "left")) - 1
    ends = [] if limit is None or at == len(ts) - 1 else [limit + width]
    while at >= 0:
        ends.append(int(ts[at]))
        at = int(after[at])
    ordered = np.array(ends[::-1], dtype=np.int64)
    return ordered[np.searchsorted(ordered, ts, "left")]


def ends_with_losses(ts: np.ndarray, width: int, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The newest time of the bucket of each row of ascending times, and which rows are not lost."""
    ends, kept = np.zeros(len(ts), dtype=np.int64), np.ones(len(ts), dtype=bool)
    after = _next(ts, width)
    at = len(ts) - 1
    if limit is not None:
        close = int(np.searchsorted(ts, limit, "left")) - 1
        ends[close + 1 :] = limit + width
        kept[close : close + 1] = False
        at = close - 1
    while at >= 0:
        close = int(after[at])
        ends[close + 1 : at + 1] = ts[at]
        if close >= 0:
            kept[close] = False
        at = close - 1
    return ends, kept


def _current(block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of sorted writes, the last one of each (group, shard, time, series), unless it has no value."""
    last = np.ones(len(block["ts_ns"]), dtype=bool)
    last[:-1] = np.logical_or.reduce([block[c][1:] != block[c][:-1] for c in ("group_no", "shard", "ts_ns", "series_id")])
    keep = last & block["known"]
    return {name: column[keep] for name, column in block.items()}


def _blocks(batches: Iterable[pa.RecordBatch], writes: bool) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Whole shards of points as NumPy columns, and the rows at which a shard begins."""
    for block in whole_shards(batches, keys=_KEYS):
        block = _current(block) if writes else block
        if len(block["ts_ns"]):
            yield block, np.flatnonzero(starts_of(block["group_no"], block["shard"]))


def _downwards(block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of equal time so that reading backwards goes from the least value to the greatest."""
    value = np.where(np.isnan(block["value"]), np.inf, block["value"])
    order = np.lexsort((-value, block["ts_ns"], block["shard"], block["group_no"]))
    return {name: column[order] for name, column in block.items()}


def _offer(width: int, writes: bool, drop: bool):
    """Of each shard, the possible first bucket ends and the limits at which they leave it."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, begin in _blocks(batches, writes):
            head, sizes, lists = [], [0], []
            for a, b in zip(begin, np.r_[begin[1:], len(block["ts_ns"])]):
                ts = np.sort(block["ts_ns"][a:b]) if drop else np.unique(block["ts_ns"][a:b])
                exits = exit_limits(ts, width, drop)
                top = int(exits[-1])
                if drop:  # a limit meets the point that is lost; the one before it opens the bucket
                    exits = np.r_[_NO_LIMIT, exits[:-1]]
                # an orbit enters no earlier than one bucket's width before the shard's upper bound
                low = max(0, int(np.searchsorted(ts, block["end_ns"][a] - width, "left")) - 1)
                entries, exits = ts[low:], exits[low:]
                keep = np.r_[True, exits[1:] != exits[:-1]]
                head.append((int(block["group_no"][a]), int(block["shard"][a]), int(ts[0]), int(keep.sum()), top))
                sizes.append(int(keep.sum()))
                lists.append((entries[keep], exits[keep]))
            offsets = pa.array(np.cumsum(sizes).astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in zip(*head)] + [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in zip(*lists)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _TABLES.split(", ")])

    return work


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat = column.flatten().to_numpy()
    ends = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
    return (flat[a:b] for a, b in zip(ends, ends[1:]))


def _leave(entries: np.ndarray, exits: np.ndarray, top: int, limit: int | None) -> int | None:
    """The limit at which an orbit that comes in at ``limit`` leaves a shard; ``top`` without a limit."""
    found = top if limit is None else int(exits[max(int(np.searchsorted(entries, limit, "left")) - 1, 0)])
    return None if found == _NO_LIMIT else found


def _tables(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    return zip(_lists(batch.column("entries")), _lists(batch.column("exits")), batch.column("top").to_pylist())


def _follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hand the limit on from shard to shard, newest first, stretch by stretch of each group, from its ``coming`` limit."""
    stretch, limit = None, None
    for batch in batches:
        rows = []
        heads = zip(*(batch.column(c).to_pylist() for c in ("group_no", "stretch", "coming", "shard", "oldest")))
        for (number, part, coming, shard, first), table in zip(heads, _tables(batch)):
            if (number, part) != stretch:
                stretch, limit = (number, part), coming
            rows.append((number, shard, limit))
            if limit is None or first < limit:
                limit = _leave(*table, limit)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["group_no", "shard", "limit_ns"])


def _through(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One table for each stretch of shards: at which limit an orbit leaves its oldest shard.

    The tables of the shards an orbit can enter, those within a bucket's width of the stretch's upper bound, are carried
    through the older shards, all entries at once. Entries whose orbits have met are one from then on.
    """
    held: dict | None = None

    def done() -> pa.RecordBatch:
        entries, exits = np.concatenate(held["entries"][::-1]), np.concatenate(held["exits"][::-1])
        keep = np.r_[True, exits[1:] != exits[:-1]]
        row = [held["key"][0], held["key"][1], held["oldest"], int(keep.sum()), held["top"], entries[keep].tolist(), exits[keep].tolist()]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], [x.split()[0] for x in _TABLES.split(", ")])

    def carried(exits: np.ndarray, table: tuple[np.ndarray, np.ndarray, int], oldest: int) -> np.ndarray:
        own, leave, top = table
        found = leave[np.maximum(np.searchsorted(own, exits, "left") - 1, 0)]
        return np.where(exits == _NO_LIMIT, top, np.where(exits > oldest, found, exits))

    for batch in batches:
        for number, part, until, oldest, table in zip(*(batch.column(c).to_pylist() for c in ("group_no", "stretch", "until", "oldest")), _tables(batch)):
            if held is None or held["key"] != (number, part):
                if held is not None:
                    yield done()
                held = {"key": (number, part), "entries": [table[0]], "exits": [table[1]], "top": table[2], "oldest": oldest, "open": oldest >= until - width}
                continue
            held["exits"] = [carried(x, table, oldest) for x in held["exits"]]
            held["top"] = int(carried(np.array([held["top"]]), table, oldest)[0])
            held["oldest"] = oldest
            if held["open"]:
                held["entries"].append(table[0])
                held["exits"].append(table[1])
                held["open"] = oldest >= until - width
    if held is not None:
        yield done()


def _look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The limits at which the orbits that come in at ``limit_ns`` leave the one shard given per group."""
    for batch in batches:
        exits = [_leave(*table, limit) for table, limit in zip(_tables(batch), batch.column("limit_ns").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("group_no"), batch.column("shard"), pa.array(exits, pa.int64())], ["group_no", "shard", "limit_ns"])


def _limits(tables: DataFrame, width_ns: int) -> DataFrame:
    """``group_no, shard, limit_ns`` of every shard of ``tables``; null: no newer bucket reaches below the shard's points."""
    groups = tables.groupBy("group_no").agg(F.sum("n_entries").alias("n"), F.count("*").alias("shards"), F.min("oldest").alias("low"), F.max("shard").alias("high"))
    # a round passes at least one bucket and one shard of each group
    rounds = F.least((F.col("high") - F.col("low")) / F.lit(max(width_ns, 1)) + 2, F.col("shards"))
    dense = dimension(groups.where(F.col("n") > rounds * ROUND_ENTRIES).select("group_no"))
    none = F.lit(None).cast("long")
    if not dense.limit(1).count():
        return _followed(tables, width_ns)
    plain = join_dimension(tables, dense.withColumn("dense", F.lit(True)), "group_no", F.col("shard"), "left").where("dense IS NULL").drop("dense")
    state = dense.withColumns({"shard": F.lit((1 << 63) - 1), "limit_ns": none})
    visits: list[DataFrame] = []
    heads = tables.select("group_no", F.col("shard").alias("next"), "oldest")
    while True:
        # the newest shard below the last one that has points below the limit
        met = join_dimension(heads, state, "group_no", F.col("next")).where("next < shard AND (limit_ns IS NULL OR oldest < limit_ns)")
        asked = met.groupBy("group_no").agg(F.max("next").alias("shard"), F.first("limit_ns").alias("limit_ns"))
        found = tables.join(asked, ["group_no", "shard"]).select("group_no", "shard", "limit_ns", "top", "entries", "exits")
        state = dimension(found.mapInArrow(_look_up, "group_no bigint, shard bigint, limit_ns bigint"))
        if not state.limit(1).count():
            break
        visits.append(state)
    known = reduce(DataFrame.unionByName, visits).select("group_no", "shard", F.struct("limit_ns").alias("left"))
    down = W.partitionBy("group_no").orderBy(F.desc("shard")).rowsBetween(W.unboundedPreceding, -1)
    passed = join_dimension(heads.withColumnRenamed("next", "shard"), dense, "group_no", F.col("shard")).join(known, ["group_no", "shard"], "left")
    through = passed.select("group_no", "shard", F.last("left", ignorenulls=True).over(down).getField("limit_ns").alias("limit_ns"))
    return through.unionByName(_followed(plain, width_ns))


def _followed(tables: DataFrame, width_ns: int) -> DataFrame:
    """The limits of all shards; large groups are followed in stretches of ``STRETCH_BUCKETS`` bucket widths.

    The tables of a stretch become one, at all stretches at once. These are followed group by group, and then the shards of
    every stretch from its own coming limit.
    """
    none = F.lit(None).cast("long")
    large = dimension(tables.groupBy("group_no").agg(F.sum("n_entries").alias("n")).where(F.col("n") > STREAMED_ENTRIES).select("group_no"))
    if not large.limit(1).count():
        return _in_stretches(tables.withColumns({"stretch": F.lit(0).cast("long"), "coming": none}))
    marked = join_dimension(tables, large.withColumn("large", F.lit(True)), "group_no", F.col("shard"), "left")
    small = marked.where("large IS NULL").withColumns({"stretch": F.lit(0).cast("long"), "coming": none})
    span = F.lit(min(STRETCH_BUCKETS * max(width_ns, 1), 1 << 62)).cast("long")
    cut = marked.where("large").withColumn("stretch", F.expr("shard") - F.pmod("shard", span))
    # a shard belongs to the stretch in which it begins and may reach beyond it
    above = F.lag("shard").over(W.partitionBy("group_no").orderBy(F.desc("shard")))
    bounds = cut.select("group_no", "shard", "stretch", above.alias("above")).groupBy("group_no", "stretch").agg(F.max_by("above", "shard").alias("above"))
    until = F.coalesce("above", F.lit((1 << 63) - 1))
    bounded = join_dimension(cut, dimension(bounds.select("group_no", "stretch", until.alias("until"))), ["group_no", "stretch"], F.col("shard"))
    ordered = bounded.repartition("group_no", "stretch").sortWithinPartitions("group_no", "stretch", F.desc("shard"))
    merged_tables = staged(ordered.mapInArrow(lambda batches: _through(batches, width_ns), _TABLES))
    coming = staged(_in_stretches(merged_tables.withColumns({"stretch": F.lit(0).cast("long"), "coming": none})))
    coming = coming.select("group_no", F.col("shard").alias("stretch"), F.col("limit_ns").alias("coming"))
    known = join_dimension(cut, coming, ["group_no", "stretch"], F.col("shard"))
    return _in_stretches(small.select(*tables.columns, "stretch", "coming").unionByName(known.select(*tables.columns, "stretch", "coming")))


def _in_stretches(tables: DataFrame) -> DataFrame:
    ordered = tables.repartition("group_no", "stretch").sortWithinPartitions("group_no", "stretch", F.desc("shard"))
    return ordered.mapInArrow(_follow, "group_no bigint, shard bigint, limit_ns bigint")


def _assign(width: int, writes: bool, drop: bool):
    """Partial aggregates of the buckets of each shard, in the order of their newest times."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, begin in _blocks(batches, writes):
            block = _downwards(block) if drop else block
            ends, kept = np.empty(len(block["ts_ns"]), dtype=np.int64), np.ones(len(block["ts_ns"]), dtype=bool)
            for a, b in zip(begin, np.r_[begin[1:], len(ends)]):
                limit = None if block["limit_ns"][a] == _NO_LIMIT else int(block["limit_ns"][a])
                if drop:
                    ends[a:b], kept[a:b] = ends_with_losses(block["ts_ns"][a:b], width, limit)
                else:
                    distinct, back = np.unique(block["ts_ns"][a:b], return_inverse=True)
                    ends[a:b] = bucket_ends(distinct, width, limit)[back]
            if drop:
                block, ends = {name: column[kept] for name, column in block.items()}, ends[kept]
            if not len(ends):
                continue
            at = np.flatnonzero(starts_of(block["group_no"], block["shard"], ends))
            value = block["value"]
            with np.errstate(invalid="ignore", over="ignore"):
                folds = [np.add.reduceat(value, at), np.fmin.reduceat(value, at), np.fmax.reduceat(value, at)]
            columns = [block["group_no"][at], ends[at], block["ts_ns"][at], np.diff(np.r_[at, len(ends)]), *folds]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in _PARTIAL.split(", ")])

    return work


def plan_groups(points: DataFrame, target_rows: int = TARGET_ROWS) -> tuple[DataFrame, ShardPlan]:
    """``group, group_no`` of each group, and its shards (the plan's keys have ``group`` too)."""
    plan = plan_shards(points.select("group", "ts_ns"), key="group", target_rows=target_rows)
    keys = dimension(plan.keys.withColumn("group_no", F.monotonically_increasing_id()))  # numbers that stay
    return with_known_rows(keys.select("group", "group_no"), known_rows(keys)), replace(plan, keys=keys)


def fold_shards(points: DataFrame, plan: ShardPlan, width_ns: int, writes: bool, drop: bool) -> DataFrame:
    """Partial aggregates ``group_no, bucket_end, start, len, total, least, most`` of the buckets of each shard.

    ``points`` has ``group, series_id, ts_ns, value, ingest_seq, known``.
    """
    order = ["group_no", "shard", "ts_ns", *(["series_id", "ingest_seq", "value"] if writes else [])]

    def in_shards(rows: DataFrame) -> DataFrame:
        return rows.repartition("group_no", "shard").sortWithinPartitions(*order)

    cut = located(points, plan).select("group_no", "shard", "end_ns", "last_ns", "series_id", "ts_ns", "ingest_seq", "value", "known")
    several = plan.keys.where("last_ns - origin_ns >= width_ns OR recut")
    if several.limit(1).count():
        wanted = dimension(several.select("group", F.lit(True).alias("several")))
        large = located(join_dimension(points, wanted, "group", F.col("ts_ns")), plan).select("group_no", "shard", "end_ns", "series_id", "ts_ns", "ingest_seq", "known", "value")
        tables = staged(in_shards(large).mapInArrow(_offer(width_ns, writes, drop), _TABLES))
        limits = staged(_limits(tables, width_ns))
        cut = join_dimension(cut, limits, ["group_no", "shard"], F.col("ts_ns"), "left")
    else:
        cut = cut.withColumn("limit_ns", F.lit(None).cast("long"))
    ready = cut.select("group_no", "shard", "series_id", "ts_ns", "ingest_seq", "value", "known", F.coalesce("limit_ns", F.lit(_NO_LIMIT)).alias("limit_ns"))
    return in_shards(ready).mapInArrow(_assign(width_ns, writes, drop), _PARTIAL)


def merged(agg: str) -> Column:
    """The value of a bucket from the partial aggregates of its shards; as :func:`aggregate` has it."""
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in ("least", "most")}
    values = {
        "count": F.sum("len").cast("double"), "sum": F.sum("total"), "avg": F.sum("total") / F.sum("len"),
        "min": F.coalesce(F.min(known["least"]), F.lit(float("nan"))), "max": F.coalesce(F.max(known["most"]), F.lit(float("nan"))),
    }
    return values[agg]


def _fold(width: int, drop: bool):
    """Row by row, in the order given: runs of one series are descending in time."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, end, number = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, rank, ts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group_no", "turn", "ts_ns"))
            marks = np.full(len(ts), -1, dtype=np.int64)
            begin = np.flatnonzero(starts_of(groups, rank))
            for a, b in zip(begin, np.r_[begin[1:], len(ts)]):
                if groups[a] != group:
                    group, end, number = groups[a], None, number + 1
                down = -ts[a:b]
                at = 0
                while at < b - a:
                    if end is None:
                        end, number = int(ts[a + at]), number + 1
                    if ts[a + at] > end:
                        stop = at
                    else:
                        stop = int(np.searchsorted(down, -(end - width), "right"))
                    marks[a + at : a + stop] = number
                    if stop < b - a:  # this row closes the bucket
                        end = None
                        stop += drop
                    at = stop
            keep = marks >= 0
            columns = [groups, ts, batch.column("value").to_numpy(zero_copy_only=False), marks]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["group_no", "ts_ns", "value", "bucket_end"])

    return work


def assign_streamed(points: DataFrame, width_ns: int, drop: bool) -> DataFrame:
    """``group_no, ts_ns, value, bucket_end`` series by series, from ``group_no, series_id, ts_ns, value``.

    ``bucket_end`` only tells buckets of a group apart here.
    """
    newest = points.groupBy("group_no", "series_id").agg(F.max("ts_ns").alias("turn"))
    points = points.join(newest, ["group_no", "series_id"])
    order = ["group_no", "turn", "series_id", F.desc("ts_ns"), "value"]
    ready = points.repartition("group_no").sortWithinPartitions(*order).select("group_no", "turn", "ts_ns", "value")
    return ready.mapInArrow(_fold(width_ns, drop), "group_no bigint, ts_ns bigint, value double, bucket_end bigint")


def bucketed(
    points: DataFrame,
    agg: str,
    width_ns: int,
    *,
    boundary: str = "keep",
    order: str = "time",
    single: bool = False,
    writes: bool = False,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """``group, start, end, value, len`` from points ``group, series_id, ts_ns, value``.

    ``start`` and ``end`` are the times of the oldest and newest point of the bucket. Rows with a null group
    or value are no points; NaN values are. ``writes`` says that the rows are writes with ``ingest_seq``: the last one
    of a series and time is the point (:func:`last_writes`). ``single`` says that one bucket holds each group, which
    needs no assignment at all.
    """
    if width_ns < 0:
        raise InvalidQuery("the width of buckets cannot be negative")
    if boundary not in ("keep", "drop") or order not in ("time", "series"):
        raise InvalidQuery("boundary is 'keep' or 'drop', order is 'time' or 'series'")
    value = aggregate(agg).alias("value")
    result = [F.min("ts_ns").alias("start"), F.max("ts_ns").alias("end"), value, F.count(F.lit(1)).alias("len")]
    points = points.where("group IS NOT NULL AND ts_ns IS NOT NULL")
    single = single and boundary == "keep" and order == "time"
    if order == "time" and not single:
        seq = F.col("ingest_seq") if writes else F.lit(0)
        rows = points.select("group", "series_id", "ts_ns", F.col("value").cast("double").alias("value"), seq.cast("long").alias("ingest_seq"), F.col("value").isNotNull().alias("known"))
        rows = rows if writes else rows.where("known")
        names, plan = plan_groups(rows, target_rows)
        folded = fold_shards(rows, plan, width_ns, writes, boundary == "drop").groupBy("group_no", "bucket_end")
        folded = folded.agg(F.min("start").alias("start"), merged(agg).alias("value"), F.sum("len").alias("len")).withColumnRenamed("bucket_end", "end")
        return join_dimension(folded, names, "group_no", F.col("end")).select("group", "start", "end", "value", "len")
    points = last_writes(points) if writes else points.where("value IS NOT NULL")
    if single:
        return points.groupBy("group").agg(*result)
    points = staged(points)
    names = dimension(points.select("group").distinct().select("group", F.monotonically_increasing_id().alias("group_no")))
    numbered = join_dimension(points, names, "group", F.col("ts_ns")).select("group_no", "series_id", "ts_ns", "value")
    folded = assign_streamed(numbered, width_ns, boundary == "drop").groupBy("group_no", "bucket_end").agg(*result)
    return join_dimension(folded, names, "group_no", F.col("end")).select("group", "start", "end", "value", "len")


def last_writes(writes: DataFrame) -> DataFrame:
    """``group, series_id, ts_ns, value``: of the writes of a series and time the one with the highest ``ingest_seq``
    (of equal ones the greatest value, null the least); if it is null there is no point."""
    newest = F.max(F.struct("ingest_seq", "value")).getField("value").alias("value")
    return writes.groupBy("group", "series_id", "ts_ns").agg(newest).where("value IS NOT NULL")


def middle() -> Column:
    """The time halfway between ``start`` and ``end`` of a bucket."""
    return F.expr("start + (`end` - start) div 2")
