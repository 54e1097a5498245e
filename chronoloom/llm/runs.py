"""Collapse runs of repeated consecutive events into one event each.

Events of an entity are taken in order of time. A run goes on while the next event is within ``tolerance``
of the run's reference and follows the last event within ``max_gap_ns``; the reference is the event before
(``compare="previous"``) or the run's first event (``compare="anchor"``). Equal values never differ, so
equal infinities form runs.

The state machine runs over sorted time shards. A break that does not depend on the machine's state (a step
larger than the tolerance, or twice the tolerance for anchors, or a time gap) makes everything after it
independent of what came before, so the events between the first and the last such break of a shard are
finished there. What goes on to a second pass are the events before the first and after the last one, with equal
neighbours folded.

With ``compare="previous"`` these are one row per shard border or two, which the same machine joins entity by entity.
With anchors a slowly drifting entity may have no certain break at all. There each shard states where the run that is
open at its end begins, for every way its first run can be broken off: by one of the shard's first events above (below)
all before it, since nothing else can be the first to be too far from an anchor. Following these tables gives every
shard the run that comes in, and then the shards are finished at once; the parts of a run have its begin in common.

Null and NaN values are no events; events repeated at one time count once (``shards.latest``). Entities
without a tolerance have tolerance 0. A single event is a run of count 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoloom.operators.shards import latest, plan_shards, sharded, starts_of, valid_points, whole_shards
from chronoloom.operators.staging import join_dimension, staged

_NAMES = ["series_id", "shard", "start_ns", "end_ns", "n", "first", "last", "tolerance", "open", "fresh"]
_PARTIAL = "series_id bigint, shard bigint, start_ns bigint, end_ns bigint, n bigint, first double, last double, tolerance double, open boolean, fresh boolean"
RUNS = "series_id bigint, start_ns bigint, end_ns bigint, n bigint, value double, duration_ns bigint"


def _differs(a: np.ndarray, b: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return ~((a == b) | (np.abs(a - b) <= tolerance))


def _anchor_breaks(value: np.ndarray, tolerance: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Add to the certain breaks those the anchors make, by jumping from run to run."""
    breaks = breaks.copy()
    ends = np.r_[np.flatnonzero(breaks)[1:], len(value)]
    for start, end in zip(np.flatnonzero(breaks), ends):
        while start < end:
            width = 64
            at = start + 1
            while at < end:
                off = np.flatnonzero(_differs(value[at : min(end, at + width)], value[start], tolerance[start]))
                if len(off):
                    at += int(off[0])
                    breaks[at] = True
                    break
                at, width = min(end, at + width), width * 4
            start = at
    return breaks


def _shard_runs(anchored: bool, max_gap_ns: int | None):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in whole_shards(batches):
            block = latest(raw)
            ts, value = block["ts_ns"], block["value"]
            if not len(ts):
                continue
            series, tolerance = block["series_id"], np.nan_to_num(block["tolerance"])
            shard_start = starts_of(series, block["shard"])
            gap = np.zeros(len(ts), dtype=bool)
            if max_gap_ns is not None:
                gap[1:] = np.diff(ts) > max_gap_ns
            sure = shard_start.copy()
            sure[1:] |= _differs(value[1:], value[:-1], tolerance[1:] * (2 if anchored else 1)) | gap[1:]
            segment = np.cumsum(sure)
            group = np.cumsum(shard_start)
            # the first and the last segment of a shard may go on beyond it
            bounds = np.flatnonzero(shard_start)
            first_segment, last_segment = segment[bounds], segment[np.r_[bounds[1:] - 1, len(ts) - 1]]
            border = (segment == first_segment[group - 1]) | (segment == last_segment[group - 1])
            breaks = _anchor_breaks(value, tolerance, sure) if anchored else sure
            if anchored:
                folded = sure.copy()
                folded[1:] |= value[1:] != value[:-1]
                breaks = np.where(border, folded, breaks)
            start = np.flatnonzero(breaks)
            end = np.r_[start[1:], len(ts)] - 1
            fresh = sure & ~shard_start  # a border event behind a certain break continues nothing
            columns = [series[start], block["shard"][start], ts[start], ts[end], end - start + 1, value[start], value[end], tolerance[start], border[start], fresh[start]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _NAMES)

    return work


def _stitch(max_gap_ns: int | None):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list | None = None  # series, start, end, n, first, last
        for batch in batches:
            done: list[tuple] = []
            for series, _, start, end, n, first, last, tolerance, _, fresh in zip(*(c.to_pylist() for c in batch.columns)):
                if run is not None and run[0] == series and not fresh and (max_gap_ns is None or start - run[2] <= max_gap_ns):
                    if first == run[5] or abs(first - run[5]) <= tolerance:
                        run[2], run[3], run[5] = end, run[3] + n, last
                        continue
                if run is not None:
                    done.append(tuple(run))
                run = [series, start, end, n, first, last]
            if done:
                yield _finished(done)
        if run is not None:
            yield _finished([tuple(run)])

    return work


class _Border:
    """The border events of one shard in order: up to its first certain break, and from its last one on."""

    def __init__(self, block: dict[str, np.ndarray], a: int, b: int):
        self.value, self.start, self.end, self.n = (block[c][a:b] for c in ("first", "start_ns", "end_ns", "n"))
        self.tolerance = block["tolerance"][a]
        fresh = np.flatnonzero(block["fresh"][a:b])
        #: where the events behind the last certain break begin
        self.cut = int(fresh[0]) if len(fresh) else b - a
        self.upto = np.r_[0, np.cumsum(self.n)]

    def broken(self, anchor: float, begin: int, end: int) -> int:
        """The first event of ``begin`` to ``end`` that is too far from the anchor, else ``end``."""
        width = 64
        while begin < end:
            off = np.flatnonzero(_differs(self.value[begin : min(end, begin + width)], anchor, self.tolerance))
            if len(off):
                return begin + int(off[0])
            begin, width = begin + width, width * 4
        return end

    def runs(self, begin: int, end: int) -> list[int]:
        """Begins of the runs of ``begin`` to ``end``, of which the first begins at ``begin``."""
        found = []
        while begin < end:
            found.append(begin)
            begin = self.broken(self.value[begin], begin + 1, end)
        return found

    def last_runs(self, begins: np.ndarray) -> list[int]:
        """For each begin of a run before the cut, the begin of the last run before it."""
        known: dict[int, int] = {}
        for begin in begins[::-1].tolist():
            path = []
            while begin not in known:
                path.append(begin)
                after = self.broken(self.value[begin], begin + 1, self.cut)
                if after == self.cut:
                    known[begin] = begin
                    break
                begin = after
            for p in path:
                known[p] = known[begin]
        return [known[b] for b in begins.tolist()]


_SUMMARY = (
    "series_id bigint, shard bigint, tolerance double, first_ns bigint, last_ns bigint, n bigint, closed boolean, end_value double, end_start bigint, end_n bigint, "
    "at array<bigint>, value array<double>, exit_value array<double>, exit_start array<bigint>, exit_n array<bigint>"
)


def _border_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], int, _Border]]:
    for block in whole_shards(batches):
        begin = np.flatnonzero(starts_of(block["series_id"], block["shard"]))
        for a, b in zip(begin, np.r_[begin[1:], len(block["shard"])]):
            yield block, a, _Border(block, a, b)


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard, which run is open at its end, by the event that breaks off the run that comes in."""
    for block, a, border in _border_shards(batches):
        value, whole = border.value[: border.cut], int(border.upto[-1])
        closed = border.cut < len(border.value)
        end = border.runs(border.cut, len(border.value))[-1] if closed else 0
        # the first event, and those above or below all before them
        record = np.r_[True, (value[1:] > np.maximum.accumulate(value)[:-1]) | (value[1:] < np.minimum.accumulate(value)[:-1])]
        at = np.flatnonzero(record)
        exits = np.array([0] * len(at) if closed else border.last_runs(at))
        row = (
            int(block["series_id"][a]), int(block["shard"][a]), float(border.tolerance), int(border.start[0]), int(border.end[-1]), whole, closed,
            float(border.value[end]), int(border.start[end]), whole - int(border.upto[end]),
            at.tolist(), value[at].tolist(), border.value[exits].tolist(), border.start[exits].tolist(), (whole - border.upto[exits]).tolist(),
        )
        yield pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in _SUMMARY.split(", ")], row))], _arrow(_SUMMARY))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


_COMING = "series_id bigint, shard bigint, anchor double, run_start bigint"


def _coming(max_gap_ns: int | None):
    """Hand the open run on from shard to shard, entity by entity."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, run, last = None, None, 0
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                x = {name: batch.column(name)[i] for name in batch.schema.names}
                head = {k: v.as_py() for k, v in x.items() if not pa.types.is_list(v.type)}
                if head["series_id"] != series or (max_gap_ns is not None and head["first_ns"] - last > max_gap_ns):
                    run = None
                series, last = head["series_id"], head["last_ns"]
                rows.append({"series_id": series, "shard": head["shard"], "anchor": run and run[0], "run_start": run and run[1]})
                values = x["value"].values.to_numpy(zero_copy_only=False)
                off = [0] if run is None else np.flatnonzero(_differs(values, run[0], head["tolerance"]))
                if head["closed"]:
                    run = (head["end_value"], head["end_start"])
                elif len(off):
                    run = (x["exit_value"][int(off[0])].as_py(), x["exit_start"][int(off[0])].as_py())
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _arrow(_COMING))

    return work


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of runs of each shard, the one that comes in among them."""
    for block, a, border in _border_shards(batches):
        known = bool(block["comes_in"][a])
        first = border.broken(block["anchor"][a], 0, border.cut) if known else 0
        begins = ([0] if first else []) + border.runs(first, border.cut) + border.runs(border.cut, len(border.value))
        begins = np.array(begins)
        ends = np.r_[begins[1:], len(border.value)]
        start, value = border.start[begins].copy(), border.value[begins].copy()
        if first:
            start[0], value[0] = block["run_start"][a], block["anchor"][a]
        series = np.full(len(begins), block["series_id"][a])
        columns = [series, start, border.end[ends - 1], border.upto[ends] - border.upto[begins], value]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["series_id", "start_ns", "end_ns", "n", "value"])


def _joined_by_anchor(borders: DataFrame, max_gap_ns: int | None) -> DataFrame:
    """The runs of the border events; a shard's are at most its folded events, and only tables meet across shards."""

    def in_shards(df: DataFrame) -> DataFrame:
        return df.repartition("series_id", "shard").sortWithinPartitions("series_id", "shard", "start_ns")

    summed = in_shards(borders).mapInArrow(_summaries, _SUMMARY)
    coming = staged(summed.repartition("series_id").sortWithinPartitions("series_id", "shard").mapInArrow(_coming(max_gap_ns), _COMING))
    met = join_dimension(borders, coming, ["series_id", "shard"], F.col("start_ns")).withColumn("comes_in", F.col("run_start").isNotNull())
    parts = in_shards(met).mapInArrow(_finish, "series_id bigint, start_ns bigint, end_ns bigint, n bigint, value double")
    whole = parts.groupBy("series_id", "start_ns").agg(F.max("end_ns").alias("end_ns"), F.sum("n").alias("n"), F.first("value").alias("value"))
    return whole.withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))


def _finished(rows: list[tuple]) -> pa.RecordBatch:
    series, start, end, n, first, _ = zip(*rows)
    columns = [series, start, end, n, first, [e - s for s, e in zip(start, end)]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in RUNS.split(", ")])


def collapse_runs(
    points: DataFrame, described: DataFrame, *, compare: str = "previous", max_gap_ns: int | None = None, target_rows: int = 1 << 16
) -> DataFrame:
    """``series_id, start_ns, end_ns, n, value, duration_ns``: one row per run, ``value`` its first event's.

    ``points`` are stored points (the highest ``ingest_seq`` at a time wins), ``described`` has ``series_id``
    and ``tolerance`` for the series wanted. One shuffle of the points by (series, time shard), one of the
    border events: by series, or with anchors by shard, and of the shards' tables by series.
    """
    if compare not in ("previous", "anchor"):
        raise ValueError(f"compare must be 'previous' or 'anchor', not {compare!r}")
    anchored = compare == "anchor"
    known = described.select("series_id", F.coalesce(F.col("tolerance").cast("double"), F.lit(0.0)).alias("tolerance"))
    plan = plan_shards(valid_points(points), known, target_rows=target_rows)
    partial = staged(sharded(points, plan, ["tolerance"]).mapInArrow(_shard_runs(anchored, max_gap_ns), _PARTIAL))
    whole = partial.where("NOT open").select(
        "series_id", "start_ns", "end_ns", "n", F.col("first").alias("value"), (F.col("end_ns") - F.col("start_ns")).alias("duration_ns")
    )
    borders = partial.where("open")
    if anchored:
        return whole.unionByName(_joined_by_anchor(borders, max_gap_ns))
    return whole.unionByName(borders.repartition("series_id").sortWithinPartitions("series_id", "start_ns").mapInArrow(_stitch(max_gap_ns), RUNS))
