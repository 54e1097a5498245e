"""Percentiles per group over very many values, by distributed multi-select.

Values are kept as *pieces*: sorted arrays of at most ``PIECE`` values of one part (a series, a day, a
partition). Pieces of separate partitions or days are combined by a union, nothing is recomputed. A group is
any set of parts.

Each round every partition proposes local order statistics of what is left of each group's range, weighted
by how many values they stand for. The weighted quantile of the proposals at the wanted rank becomes the
pivot, together with one on either side of it. The pieces that meet the range count its values below and equal to the
pivots by binary search, the counts are added up per group, and the ranges that cannot hold the wanted rank are
discarded. A range is finished when its pivot has the wanted rank, when it holds no more than
``max_rank_error`` of the group's values (any of them is then within that rank error), or when it holds at
most ``FINISH`` values, which are then sorted. With ``max_rank_error=0`` results are exact.

The percentile p of n values is the value of rank ``ceil(p * n)`` (at least 1). Null and NaN values are left
out, infinite ones are ordered. A group without values has no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronoloom.operators.shards import latest, plan_shards, sharded, starts_of, valid_points, whole_shards
from chronoloom.operators.staging import dimension, join_dimension, unstage

#: Values of a piece at most.
PIECE = 2048
#: Local order statistics a partition proposes for a range.
PROPOSALS = 64
#: Values left in a range that are gathered and sorted.
FINISH = 4096
#: Ranges a partition keeps account of before it hands on what it has.
OPEN_RANGES = 20_000

_PIECES = "series_id bigint, vals array<double>, n bigint, least double, most double"


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for raw in whole_shards(batches):
        block = latest(raw)
        series, value = block["series_id"], block["value"]
        if not len(series):
            continue
        shard_of = np.cumsum(starts_of(series, block["shard"]))
        order = np.lexsort((value, shard_of))
        bounds = np.flatnonzero(starts_of(series, block["shard"]))
        sizes = np.diff(np.r_[bounds, len(series)])
        offset = np.arange(len(series)) - np.repeat(bounds, sizes)
        yield _pieces(series, value[order], np.flatnonzero(offset % PIECE == 0))


def _pieces(series: np.ndarray, value: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
    """Pieces of sorted values that begin at ``begin``, with their number and ends."""
    ends = np.r_[begin, len(series)]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(value))
    return pa.RecordBatch.from_arrays([pa.array(series[begin]), lists, *map(pa.array, (np.diff(ends), value[begin], value[ends[1:] - 1]))], [x.split()[0] for x in _PIECES.split(", ")])


def reading_pieces(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Pieces ``series_id, vals, n`` of the current readings of the series in ``ids``."""
    plan = plan_shards(valid_points(points), ids.select("series_id"))
    return sharded(points, plan, []).mapInArrow(_cut, _PIECES)


def value_pieces(values: DataFrame) -> DataFrame:
    """Pieces of ``series_id, value`` rows as they lie in their partitions; no shuffle."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            series, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.lexsort((value, series))
            series, value = series[order], value[order]
            bounds = np.flatnonzero(starts_of(series))
            offset = np.arange(len(series)) - np.repeat(bounds, np.diff(np.r_[bounds, len(series)]))
            if len(series):
                yield _pieces(series, value, np.flatnonzero(offset % PIECE == 0))

    good = values.where("series_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    return good.select(F.col("series_id").cast("long"), F.col("value").cast("double")).mapInArrow(gather, _PIECES)


def thin(values: np.ndarray, weights: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``keep`` weighted representatives, evenly spaced in rank; the weights add up as before."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    if len(values) <= keep:
        return values, weights
    total = np.cumsum(weights)
    edges = total[-1] * np.arange(1, keep + 1) / keep
    at = np.searchsorted(total, edges - total[-1] / (2 * keep))
    return values[np.minimum(at, len(values) - 1)], np.diff(np.r_[0.0, edges])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[dict]]]:
    lists = batch.column("vals")
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
    for i, work in enumerate(batch.column("work").to_pylist()):
        yield flat[ends[i] : ends[i + 1]], work


def _within(values: np.ndarray, work: dict) -> tuple[int, int]:
    """Slice of sorted values strictly between the bounds; a bound of None is no bound."""
    a = 0 if work["low"] is None else int(np.searchsorted(values, work["low"], "right"))
    b = len(values) if work["high"] is None else int(np.searchsorted(values, work["high"], "left"))
    return a, b


def _propose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}

    def hand_on() -> pa.RecordBatch:
        rows = []
        for (group, before, left), parts in held.items():
            values, weights = thin(np.concatenate([v for v, _ in parts]), np.concatenate([w for _, w in parts]), PROPOSALS)
            rows += [(group, before, left, v, w) for v, w in zip(values.tolist(), weights.tolist())]
        held.clear()
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["group_id", "before", "left", "proposal", "weight"])

    for batch in batches:
        for values, work in _slices(batch):
            for w in work:
                a, b = _within(values, w)
                if a >= b:
                    continue
                parts = held.setdefault((w["group_id"], w["before"], w["left"]), [])
                parts.append(thin(values[a:b], np.ones(b - a), PROPOSALS))
                if sum(len(v) for v, _ in parts) > 64 * PROPOSALS:
                    parts[:] = [thin(np.concatenate([v for v, _ in parts]), np.concatenate([x for _, x in parts]), 4 * PROPOSALS)]
        if len(held) > OPEN_RANGES:
            yield hand_on()
    if held:
        yield hand_on()


_COUNTED = "group_id string, before bigint, left bigint, pivot double, below bigint, equal bigint"


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range and pivot, how many values within the range are below and equal to it."""
    counts: dict[tuple, list[int]] = {}

    def hand_on() -> pa.RecordBatch:
        rows = [(*key, *n) for key, n in counts.items()]
        counts.clear()
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _COUNTED.split(", ")])

    for batch in batches:
        for values, work in _slices(batch):
            for w in work:
                a, b = _within(values, w)
                if a >= b:
                    continue
                pivots = np.array(w["pivots"])
                below = np.searchsorted(values[a:b], pivots, "left")
                equal = np.searchsorted(values[a:b], pivots, "right") - below
                for p, x, y in zip(w["pivots"], below.tolist(), equal.tolist()):
                    n = counts.setdefault((w["group_id"], w["before"], w["left"], p), [0, 0])
                    n[0] += x
                    n[1] += y
        if len(counts) > OPEN_RANGES:
            yield hand_on()
    if counts:
        yield hand_on()


def _take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for values, work in _slices(batch):
            for w in work:
                a, b = _within(values, w)
                if a < b:
                    rows.append((w["group_id"], w["before"], w["left"], values[a:b].tolist()))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["group_id", "before", "left", "vals"])


def _with_work(pieces: DataFrame, members: DataFrame, work: DataFrame) -> DataFrame:
    """Each piece with the ``work`` of all groups its part belongs to whose range it meets; a part has few groups.

    A piece that meets no open range goes no further. Its ends are columns of their own, so its values are not even looked at.
    """
    each = members.join(work, "group_id").groupBy("series_id").agg(F.collect_list(F.struct(*work.columns)).alias("work"))
    met = join_dimension(pieces, dimension(each), "series_id", F.col("first"))
    meets = F.filter("work", lambda w: (w["low"].isNull() | (F.col("most") > w["low"])) & (w["high"].isNull() | (F.col("least") < w["high"])))
    return met.select("vals", meets.alias("work")).where("size(work) > 0")


def multi_select(pieces: DataFrame, members: DataFrame, percentiles: tuple[float, ...], max_rank_error: float = 0.0) -> DataFrame:
    """``group_id, percentile, value, n`` for every group of ``members`` (``series_id, group_id``).

    ``pieces`` must be a stored table (it is read twice a round). The driver sees one number per round: how
    many ranges are open. State is written each round, so neither lineage nor driver memory grows.
    """
    pieces = pieces.withColumn("first", F.hash("least", "most"))
    members = dimension(members.where("series_id IS NOT NULL AND group_id IS NOT NULL").select("series_id", "group_id").distinct())
    sizes = pieces.groupBy("series_id").agg(F.sum("n").alias("n")).join(members, "series_id").groupBy("group_id").agg(F.sum("n").alias("n"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in percentiles])).alias("percentile")
    none = F.lit(None).cast("double")
    state = dimension(
        sizes.select("group_id", "n", wanted)
        .withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("percentile") * F.col("n"))).cast("long"))
        .withColumns({"low": none, "high": none, "before": F.lit(0).cast("long"), "left": F.col("n"), "value": none})
    )
    bound = F.greatest(F.lit(FINISH), F.floor(F.col("n") * F.lit(float(max_rank_error))))
    while state.where(F.col("value").isNull() & (F.col("left") > bound)).limit(1).count():
        state, old = _round(pieces, members, state, bound), state
        unstage(old)
    return _finish(pieces, members, state, max_rank_error)


def _ranges(state: DataFrame) -> DataFrame:
    """The distinct ranges of a state. Those that begin and end at the same ranks are the same."""
    return state.select("group_id", "before", "left", "low", "high").dropDuplicates(["group_id", "before", "left"])


def _round(pieces: DataFrame, members: DataFrame, state: DataFrame, bound: Column) -> DataFrame:
    active = state.where(F.col("value").isNull() & (F.col("left") > bound))
    schema = "group_id string, before bigint, left bigint, proposal double, weight double"
    proposals = _with_work(pieces, members, _ranges(active)).mapInArrow(_propose, schema)
    key = ["group_id", "before", "left"]
    ranked = (
        proposals.groupBy(*key, "proposal").agg(F.sum("weight").alias("weight"))
        .withColumn("upto", F.sum("weight").over(W.partitionBy(*key).orderBy("proposal")))
        .withColumn("all", F.sum("weight").over(W.partitionBy(*key)))
    )
    spots = F.explode(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0))).alias("side")
    aims = active.select(*key, "low", "high", "percentile", ((F.col("rank") - F.col("before")) / F.col("left")).alias("aim"), spots)
    aims = aims.withColumn("aim", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("aim") + F.col("side") * (1.0 / PROPOSALS))))
    reached = F.min(F.when(F.col("upto") >= F.col("aim") * F.col("all") * (1 - 1e-9), F.col("proposal")))
    pivots = aims.join(ranked, key).groupBy(*key, "low", "high", "percentile", "side").agg(F.coalesce(reached, F.max("proposal")).alias("pivot"))
    work = dimension(pivots.groupBy(*key, "low", "high").agg(F.array_sort(F.collect_set("pivot")).alias("pivots")))
    counted = _with_work(pieces, members, work).mapInArrow(_count, _COUNTED)
    totals = counted.groupBy(*key, "pivot").agg((F.sum("below") + F.col("before")).alias("below"), F.sum("equal").alias("equal"))
    found = totals.groupBy(*key).agg(F.collect_list(F.struct("pivot", "below", "equal")).alias("pivots"))
    met = state.join(found, key, "left")
    pivots_of = F.coalesce("pivots", F.array().cast("array<struct<pivot:double,below:bigint,equal:bigint>>"))
    hit = F.filter(pivots_of, lambda p: (p["below"] < F.col("rank")) & (F.col("rank") <= p["below"] + p["equal"]))
    under = F.array_max(F.transform(F.filter(pivots_of, lambda p: p["below"] + p["equal"] < F.col("rank")), lambda p: F.struct(p["pivot"].alias("pivot"), (p["below"] + p["equal"]).alias("upto"))))
    over = F.array_min(F.transform(F.filter(pivots_of, lambda p: p["below"] >= F.col("rank")), lambda p: F.struct(p["pivot"].alias("pivot"), p["below"].alias("below"))))
    open_ = F.col("value").isNull()
    raised = open_ & F.col("under").isNotNull() & (F.col("low").isNull() | (F.col("under.pivot") > F.col("low")))
    lowered = open_ & F.col("over").isNotNull() & (F.col("high").isNull() | (F.col("over.pivot") < F.col("high")))
    narrowed = met.withColumns({"hit": hit, "under": under, "over": over}).select(
        "group_id", "n", "percentile", "rank",
        F.when(raised, F.col("under.pivot")).otherwise(F.col("low")).alias("low"),
        F.when(lowered, F.col("over.pivot")).otherwise(F.col("high")).alias("high"),
        F.when(raised, F.col("under.upto")).otherwise(F.col("before")).alias("before"),
        F.when(lowered, F.col("over.below")).otherwise(F.col("before") + F.col("left")).alias("upto"),
        F.when(open_ & (F.size("hit") > 0), F.get("hit", F.lit(0))["pivot"]).otherwise(F.col("value")).alias("value"),
    )
    return dimension(narrowed.withColumn("left", F.col("upto") - F.col("before")).select("group_id", "n", "percentile", "rank", "low", "high", "before", "left", "value"))


def _finish(pieces: DataFrame, members: DataFrame, state: DataFrame, max_rank_error: float) -> DataFrame:
    """Sort what is left of small ranges; of a larger range within the error bound, take its lower pivot's neighbour."""
    small = state.where(F.col("value").isNull() & (F.col("left") <= FINISH))
    taken = _with_work(pieces, members, _ranges(small)).mapInArrow(_take, "group_id string, before bigint, left bigint, vals array<double>")
    key = ["group_id", "before", "left"]
    gathered = taken.groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list("vals"))).alias("vals"))
    exact = small.join(gathered, key).withColumn("value", F.element_at("vals", (F.col("rank") - F.col("before")).cast("int")))
    columns = ["group_id", "percentile", "value", "n"]
    done = state.where(F.col("value").isNotNull()).select(*columns).unionByName(exact.select(*columns))
    if max_rank_error:
        near = state.where(F.col("value").isNull() & (F.col("left") > FINISH))
        done = done.unionByName(near.withColumn("value", F.coalesce("low", "high")).select(*columns))
    return done
