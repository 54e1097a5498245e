"""Rolling totals over trailing periods from segment trees.

Every entity has one small tree per time shard of ``SHARD_DAYS`` days. Its leaves are the days, each
inner node holds the sum and count of its two children, and all nodes of a shard lie in one row in heap
order (node 1 is the root, node ``SHARD_DAYS + i`` the leaf of day i). A trailing period is answered from
the few nodes that cover it; a late correction changes one leaf and its ancestors.

Empty inputs give empty results. Null entities and null or negative times are no activity; null and NaN values are left out,
infinite ones stay. Repeated rows are separate amounts (dedupe readings first).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoloom.operators.shards import valid_points
from chronoloom.operators.staging import dimension, join_dimension, known_rows, with_known_rows

#: Days of a tree; a power of two. A trailing period may reach over several trees.
SHARD_DAYS = 32
DAY_NS = 86_400_000_000_000

TREE_SCHEMA = "series_id bigint, shard bigint, sums array<double>, counts array<bigint>, first_day bigint, last_day bigint"


def daily_totals(readings: DataFrame) -> DataFrame:
    """``series_id, day_no, total, n``: map-side combined totals of each day with readings (UTC days)."""
    return (
        readings.where("series_id IS NOT NULL AND ts_ns >= 0 AND value IS NOT NULL AND NOT isnan(value)")
        .withColumn("day_no", F.expr(f"(ts_ns - pmod(ts_ns, {DAY_NS})) div {DAY_NS}"))
        .groupBy("series_id", "day_no")
        .agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    )


def build_trees(daily: DataFrame) -> DataFrame:
    """One row per entity and shard: ``series_id, shard, sums, counts, first_day, last_day``.

    ``sums`` and ``counts`` have ``2 * SHARD_DAYS`` entries in heap order; entry 0 is unused and zero.
    Only (entity, shard) totals of at most ``SHARD_DAYS`` leaves are shuffled.
    """
    leaf = F.pmod("day_no", F.lit(SHARD_DAYS))
    shards = (
        daily.withColumn("shard", F.expr(f"(day_no - pmod(day_no, {SHARD_DAYS})) div {SHARD_DAYS}"))
        .groupBy("series_id", "shard", leaf.cast("int").alias("leaf"))
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("day_no").alias("day_no"))
        .groupBy("series_id", "shard")
        .agg(
            F.collect_list(F.struct("leaf", "total", "n")).alias("leaves"),
            F.min("day_no").alias("first_day"),
            F.max("day_no").alias("last_day"),
        )
    )

    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = batch.column("leaves")
            flat = leaves.flatten()
            row = np.repeat(np.arange(batch.num_rows), leaves.value_lengths().to_numpy(zero_copy_only=False))
            slot = flat.field("leaf").to_numpy(zero_copy_only=False) + SHARD_DAYS
            sums = np.zeros((batch.num_rows, 2 * SHARD_DAYS))
            counts = np.zeros((batch.num_rows, 2 * SHARD_DAYS), dtype=np.int64)
            sums[row, slot] = flat.field("total").to_numpy(zero_copy_only=False)
            counts[row, slot] = flat.field("n").to_numpy(zero_copy_only=False)
            sum_nodes(sums, counts)
            yield tree_batch(batch, sums, counts)

    return shards.mapInArrow(grow, TREE_SCHEMA)


def sum_nodes(sums: np.ndarray, counts: np.ndarray) -> None:
    """Fill every inner node from its children, level by level."""
    width = SHARD_DAYS // 2
    with np.errstate(invalid="ignore"):
        while width:
            for nodes in (sums, counts):
                nodes[:, width : 2 * width] = nodes[:, 2 * width : 4 * width : 2] + nodes[:, 2 * width + 1 : 4 * width : 2]
            width //= 2


def _lists(nodes: np.ndarray) -> pa.Array:
    offsets = np.arange(len(nodes) + 1, dtype=np.int32) * nodes.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(nodes.ravel()))


def tree_batch(like: pa.RecordBatch, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    keys = [like.column(c) for c in ("series_id", "shard")]
    ends = [like.column(c) for c in ("first_day", "last_day")]
    names = ["series_id", "shard", "sums", "counts", "first_day", "last_day"]
    return pa.RecordBatch.from_arrays([*keys, _lists(sums), _lists(counts), *ends], names)


def _by_tree(days: DataFrame) -> DataFrame:
    """``series_id, shard, leaves, late_first, late_last`` of day amounts ``series_id, day_no, total, n``, each day once."""
    return (
        days.withColumn("shard", F.expr(f"(day_no - pmod(day_no, {SHARD_DAYS})) div {SHARD_DAYS}"))
        .groupBy("series_id", "shard")
        .agg(
            F.collect_list(F.struct(F.pmod("day_no", F.lit(SHARD_DAYS)).cast("int").alias("leaf"), "total", "n")).alias("leaves"),
            F.min("day_no").alias("late_first"),
            F.max("day_no").alias("late_last"),
        )
    )


def _touched(trees: DataFrame, changes: DataFrame, replace: bool) -> DataFrame:
    """The trees that ``changes`` of :func:`_by_tree` touch, with the changed leaves and their ancestors brought up to date.

    With ``replace`` a leaf takes the new amounts and its ancestors are summed again from their children, otherwise the
    amounts are differences that are added to the leaf and to each ancestor. Only touched trees are read.
    """
    keys = ["series_id", "shard"]
    old = join_dimension(trees, with_known_rows(changes.select(*keys), known_rows(changes)), keys, F.col("shard"))
    both = changes.join(old, keys, "left").select(
        *keys, "sums", "counts", "leaves",
        F.least("first_day", "late_first").alias("first_day"), F.greatest("last_day", "late_last").alias("last_day"),
    )

    def climb(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = np.zeros((batch.num_rows, 2 * SHARD_DAYS))
            counts = np.zeros((batch.num_rows, 2 * SHARD_DAYS), dtype=np.int64)
            known = batch.column("sums").is_valid().to_numpy(zero_copy_only=False)
            sums[known] = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * SHARD_DAYS)
            counts[known] = batch.column("counts").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * SHARD_DAYS)
            leaves = batch.column("leaves")
            flat = leaves.flatten()
            row = np.repeat(np.arange(batch.num_rows), leaves.value_lengths().to_numpy(zero_copy_only=False))
            node = flat.field("leaf").to_numpy(zero_copy_only=False) + SHARD_DAYS
            total, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("total", "n"))
            with np.errstate(invalid="ignore"):
                if replace:
                    sums[row, node], counts[row, node] = total, n
                    node = node // 2
                while len(node) and node[0]:
                    if replace:
                        for nodes in (sums, counts):
                            nodes[row, node] = nodes[row, 2 * node] + nodes[row, 2 * node + 1]
                    else:
                        np.add.at(sums, (row, node), total)
                        np.add.at(counts, (row, node), n)
                    node = node // 2
            if not replace:
                yield tree_batch(batch, sums, counts)
                continue
            # days that have lost their readings are no ends of a series
            full = counts[:, SHARD_DAYS:] > 0
            day = batch.column("shard").to_numpy()[:, None] * SHARD_DAYS + np.arange(SHARD_DAYS)
            keep = full.any(axis=1)
            ends = {"first_day": np.where(full, day, np.iinfo(np.int64).max).min(axis=1), "last_day": np.where(full, day, -1).max(axis=1)}
            held = pa.RecordBatch.from_arrays([batch.column("series_id"), batch.column("shard"), *map(pa.array, ends.values())], ["series_id", "shard", *ends])
            yield tree_batch(held.filter(pa.array(keep)), sums[keep], counts[keep])

    return both.mapInArrow(climb, TREE_SCHEMA)


def _brought_in(trees: DataFrame, days: DataFrame, replace: bool) -> DataFrame:
    changes = dimension(_by_tree(days))
    keys = with_known_rows(changes.select("series_id", "shard"), known_rows(changes))
    others = join_dimension(trees, keys, ["series_id", "shard"], F.col("shard"), "left_anti")
    return others.unionByName(_touched(trees, changes, replace))


def correct_trees(trees: DataFrame, late: DataFrame) -> DataFrame:
    """Apply late amounts ``series_id, day_no, total, n`` (n may be negative) to stored trees.

    A tree with corrections gets the difference added to the leaf and to its ancestors, nothing else is
    touched or recomputed; trees without corrections pass as they are and are not shuffled, new trees are built. Amounts
    are differences, so an infinite total can be added but not taken back. A day whose count has gone to zero
    stays within ``first_day .. last_day``.
    """
    known = late.where("series_id IS NOT NULL AND day_no IS NOT NULL")
    return _brought_in(trees, known.groupBy("series_id", "day_no").agg(F.sum("total").alias("total"), F.sum("n").alias("n")), False)


def replace_days(trees: DataFrame, days: DataFrame) -> DataFrame:
    """Trees in which the days ``series_id, day_no, total, n`` have these amounts (a day without readings: 0 and 0).

    The leaf of such a day is set and its ancestors are summed again, so overwritten and infinite readings come out as
    if the tree had been built anew. A tree without readings goes away.
    """
    return _brought_in(trees, days, True)


def days_of_late_writes(points: DataFrame, described: DataFrame, after_seq: int) -> DataFrame:
    """``series_id, day_no, total, n``: the amounts by all writes of the days that writes after ``after_seq`` fall on.

    Late points, overwritten ones and ones overwritten by null are all such writes. Only the readings of these days are
    read for their totals.
    """
    ids = dimension(described.select("series_id").distinct())
    day = F.expr(f"ts_ns div {DAY_NS}")
    written = join_dimension(valid_points(points), ids, "series_id", F.col("ts_ns")).withColumn("day_no", day)
    days = dimension(written.where(F.col("ingest_seq") > after_seq).select("series_id", "day_no").distinct())
    again = join_dimension(written, days, ["series_id", "day_no"], F.col("ts_ns")).groupBy("series_id", "ts_ns")
    readings = again.agg(F.max(F.struct("ingest_seq", "value")).getField("value").alias("value"))
    return days.join(daily_totals(readings), ["series_id", "day_no"], "left").select("series_id", "day_no", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


@lru_cache
def cover(low: int, high: int) -> tuple[int, ...]:
    """Heap numbers of the fewest nodes that cover leaves ``low`` to ``high`` (inclusive)."""
    nodes: list[int] = []
    a, b = low + SHARD_DAYS, high + SHARD_DAYS + 1
    while a < b:
        if a & 1:
            nodes.append(a)
            a += 1
        if b & 1:
            b -= 1
            nodes.append(b)
        a, b = a // 2, b // 2
    return tuple(sorted(nodes))


def _lookup(days: int, reach: int) -> np.ndarray:
    """For each day of the newest of ``reach + 1`` trees laid side by side, the nodes of its period (0: none)."""
    lists = []
    for day in range(SHARD_DAYS):
        nodes: list[int] = []
        for back in range(reach, -1, -1):
            low, high = max(0, day - days + 1 + back * SHARD_DAYS), min(SHARD_DAYS - 1, day + back * SHARD_DAYS)
            if low <= high:
                nodes += [(reach - back) * 2 * SHARD_DAYS + x for x in cover(low, high)]
        lists.append(nodes)
    wide = max(map(len, lists))
    return np.array([x + [0] * (wide - len(x)) for x in lists])


def rolling_totals(trees: DataFrame, periods: tuple[int, ...] = (7, 30), from_day: int | None = None) -> DataFrame:
    """Totals, counts and averages per calendar day over trailing periods, for every entity and day.

    Columns: ``series_id, day_no`` and for each period p ``total_p``, ``n_p`` (readings), ``per_day_p``
    (total / p, idle days count) and ``mean_p`` (total / readings, null without any). Days run from the
    entity's first day plus ``from_day`` (default: the longest period less one, so that every period is
    complete) to its last day, idle days and idle shards included.

    The trees of a shard and of the ones its longest period reaches back to are brought together by a
    shuffle of tree rows, each sent to the shards that need it.
    """
    reach = -(-(max(periods) - 1) // SHARD_DAYS)
    skip = max(periods) - 1 if from_day is None else from_day
    ends = trees.groupBy("series_id").agg(
        F.min("first_day").alias("series_first"), F.max("last_day").alias("series_last"), F.max("shard").alias("top"), F.min("shard").alias("low")
    )
    wanted = ends.select("series_id", "series_first", "series_last", F.explode(F.sequence("low", "top")).alias("shard"))
    sent = trees.select("series_id", "sums", "counts", F.col("shard").alias("own"), F.explode(F.sequence(F.col("shard"), F.col("shard") + reach)).alias("shard"))
    met = sent.groupBy("series_id", "shard").agg(F.collect_list(F.struct("own", "sums", "counts")).alias("trees"))
    tables = [_lookup(p, reach) for p in periods]
    names = [f"{what}_{p}" for p in periods for what in ("total", "n", "per_day", "mean")]
    types = ", ".join(f"{n} {'bigint' if n.startswith('n_') else 'double'}" for n in names)
    node_count = (reach + 1) * 2 * SHARD_DAYS

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            shard = batch.column("shard").to_numpy()
            sums = np.zeros((rows, reach + 1, 2 * SHARD_DAYS))
            counts = np.zeros((rows, reach + 1, 2 * SHARD_DAYS), dtype=np.int64)
            found = batch.column("trees")
            flat = found.flatten()
            row = np.repeat(np.arange(rows), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            slot = reach - (shard[row] - flat.field("own").to_numpy(zero_copy_only=False))
            for nodes, name in ((sums, "sums"), (counts, "counts")):
                nodes[row, slot] = flat.field(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * SHARD_DAYS)
            sums, counts = sums.reshape(rows, node_count), counts.reshape(rows, node_count)
            day = shard[:, None] * SHARD_DAYS + np.arange(SHARD_DAYS)
            first = batch.column("series_first").to_numpy() + skip
            keep = (day >= first[:, None]) & (day <= batch.column("series_last").to_numpy()[:, None])
            out = [np.repeat(batch.column("series_id").to_numpy(), SHARD_DAYS)[keep.ravel()], day[keep]]
            for p, table in zip(periods, tables):
                with np.errstate(invalid="ignore", divide="ignore"):
                    total = sum(sums[:, table[:, i]] for i in range(table.shape[1]))[keep]
                    n = sum(counts[:, table[:, i]] for i in range(table.shape[1]))[keep]
                    out += [total, n, total / p, pa.array(total / n, mask=n == 0)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["series_id", "day_no", *names])

    return wanted.join(met, ["series_id", "shard"], "left").mapInArrow(answer, f"series_id bigint, day_no bigint, {types}")


def busy_days(rolled: DataFrame, short: int = 7, long: int = 30, factor: float = 3.0) -> DataFrame:
    """Days on which the short period's average per day is more than ``factor`` times the long period's.

    The comparison is made on totals (``long * short_total > factor * short * long_total``); a total that
    is NaN (opposite infinities met) is never greater.
    """
    left, right = F.col(f"total_{short}") * long, F.col(f"total_{long}") * (factor * short)
    return rolled.where((left > right) & ~F.isnan(left) & ~F.isnan(right)).select("series_id", "day_no")
