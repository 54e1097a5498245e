"""Irregular readings onto a regular grid, by local polynomial regression with a compact kernel.

A series' cells are ``[k * step, (k + 1) * step)``. The value of a cell is a weighted straight line through
the readings within ``bandwidth`` steps of the cell's centre, weighted by the tricube kernel and evaluated
there; nearby readings are found by their cell number. With each value goes its effective support
``(sum w)^2 / sum w^2``, the number of equally weighted readings it is worth. A cell whose support is below
``min_support`` has no value.

``status``: ``observed`` (readings in the cell), ``filled`` (none, but enough support around it) or
``missing`` (none, and too little support). Cells run from the series' first reading to its last one.
Infinite values make a cell observed but do not enter the regression. Null and NaN values are no readings;
a series without a positive step has no grid.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from chronoloom.operators.shards import latest, plan_shards, sharded, starts_of, valid_points, whole_shards
from chronoloom.operators.staging import dimension, join_dimension, staged

#: Half width of the kernel in steps.
BANDWIDTH = 2.5
#: Support below which a cell has no value.
MIN_SUPPORT = 1.5
#: Cells of a shard at most: its grid is one row of arrays.
SHARD_CELLS = 2048

_PACKED = (
    "series_id bigint, shard bigint, begin_cell bigint, first_cell bigint, last_cell bigint, step_ns bigint, "
    "counts array<int>, fits array<double>, support array<double>"
)


def _fit(at: np.ndarray, value: np.ndarray, base: np.ndarray, cells: int, bandwidth: float, min_support: float) -> tuple[np.ndarray, np.ndarray]:
    """Regression of all cells at once: ``at`` is time in steps from a shard's begin, ``base`` its first slot."""
    reach = int(np.ceil(bandwidth + 0.5))
    sums = np.zeros((6, cells))
    for offset in range(-reach, reach + 1):
        slot = np.floor(at).astype(np.int64) + offset
        x = at - (slot + 0.5)
        weight = np.clip(1 - np.abs(x / bandwidth) ** 3, 0, None) ** 3
        ok = (weight > 0) & (slot >= 0) & (slot < base[1])
        place = (base[0] + slot)[ok]
        x, y, w = x[ok], value[ok], weight[ok]
        for k, term in enumerate((w, w * x, w * x * x, w * y, w * x * y, w * w)):
            sums[k] += np.bincount(place, term, cells)
    s0, s1, s2, t0, t1, sq = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        support = np.where(sq > 0, s0 * s0 / sq, 0.0)
        spread = s0 * s2 - s1 * s1
        mean = t0 / s0
        line = (s2 * t0 - s1 * t1) / spread
        # readings all (nearly) at one time carry no slope: take their mean
        fit = np.where(spread > 1e-9 * s0 * s0, line, mean)
    return np.where(support >= min_support, fit, np.nan), support


def _pack(bandwidth: float, min_support: float):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in whole_shards(batches):
            block = latest(raw)
            if not len(block["ts_ns"]):
                continue
            first = np.flatnonzero(starts_of(block["series_id"], block["shard"]))
            rows = np.cumsum(starts_of(block["series_id"], block["shard"])) - 1
            step, begin_ns, end_ns = (block[c][first] for c in ("step_ns", "shard", "end_ns"))
            cells = (end_ns - begin_ns) // step
            starts = np.r_[0, np.cumsum(cells)]
            inner = block["ts_ns"] - begin_ns[rows]
            at = inner / step[rows]
            usable = np.isfinite(block["value"])
            base = np.stack([starts[rows], cells[rows]])
            fits, support = _fit(at[usable], block["value"][usable], base[:, usable], int(starts[-1]), bandwidth, min_support)
            own = (inner >= 0) & (inner < (cells * step)[rows])
            slot = starts[rows[own]] + inner[own] // step[rows[own]]
            counts = np.bincount(slot, minlength=starts[-1]).astype(np.int32)
            full = np.flatnonzero(counts)
            low, high = np.searchsorted(full, starts[:-1]), np.searchsorted(full, starts[1:]) - 1
            empty = low > high
            begin_cell = begin_ns // step
            safe = full if len(full) else np.zeros(1, dtype=np.int64)
            ends = [pa.array(safe[np.minimum(x, len(safe) - 1)] - starts[:-1] + begin_cell, mask=empty) for x in (low, high)]
            offsets = pa.array(starts.astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (counts, fits, support)
            ]
            series = block["series_id"][first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(series), pa.array(begin_ns), pa.array(begin_cell), *ends, pa.array(step), *lists], [x.split()[0] for x in _PACKED.split(", ")]
            )

    return pack


def regular_grid(points: DataFrame, gauges: DataFrame, bandwidth: float = BANDWIDTH, min_support: float = MIN_SUPPORT) -> DataFrame:
    """``series_id, start_ns, value, support, n_readings, status`` for every cell of every gauge.

    ``gauges`` has ``series_id, step_ns``. The points are shuffled once, by (series, time shard) with a
    halo of the kernel's reach. Each shard's grid is packed into one row of at most ``SHARD_CELLS`` cells
    and staged; the ends of the series come from the packed rows' bounds, and stretches in which no shard
    has a reading are expanded from those bounds, so a gap of any length costs no Python.
    """
    reach = int(np.ceil(bandwidth + 0.5))
    known = gauges.select("series_id", F.col("step_ns").cast("long").alias("step_ns"))
    plan = plan_shards(valid_points(points), known, step="step_ns", halo_steps=reach, most_steps=SHARD_CELLS)
    packed = staged(sharded(points, plan, ["step_ns"], halo=True).mapInArrow(_pack(bandwidth, min_support), _PACKED))
    bounds = dimension(packed.groupBy("series_id").agg(F.min("first_cell").alias("low"), F.max("last_cell").alias("high")).where("low IS NOT NULL"))
    bounded = join_dimension(packed, bounds, "series_id", F.col("shard")).where("begin_cell <= high AND begin_cell + size(counts) > low")
    after = W.partitionBy("series_id").orderBy("shard")
    behind = F.col("begin_cell") + F.size("counts")
    here = (
        packed.select("series_id", "step_ns", behind.alias("behind"), F.lead("begin_cell").over(after).alias("next_cell"))
        .where("next_cell > behind")
        .withColumn("b", F.explode(F.sequence("behind", F.col("next_cell") - 1, F.lit(SHARD_CELLS).cast("long"))))
    )
    hollow = (
        join_dimension(here, bounds, "series_id", F.col("b"))
        .select("series_id", "step_ns", "low", "high", F.explode(F.sequence("b", F.least(F.col("b") + (SHARD_CELLS - 1), F.col("next_cell") - 1))).alias("cell"))
        .withColumns({"n_readings": F.lit(0), "value": F.lit(None).cast("double"), "support": F.lit(0.0)})
    )
    solid = bounded.select(
        "series_id", "step_ns", "low", "high", "begin_cell", F.posexplode(F.arrays_zip("counts", "fits", "support")).alias("at", "x")
    ).select(
        "series_id", "step_ns", "low", "high", (F.col("begin_cell") + F.col("at")).alias("cell"), F.col("x.counts").alias("n_readings"),
        F.when(~F.isnan("x.fits"), F.col("x.fits")).alias("value"), F.col("x.support").alias("support"),
    )
    cells = solid.unionByName(hollow).where("cell BETWEEN low AND high")
    status = F.when(F.col("n_readings") > 0, "observed").when(F.col("value").isNotNull(), "filled").otherwise("missing")
    return cells.select("series_id", (F.col("cell") * F.col("step_ns")).alias("start_ns"), "value", "support", "n_readings", status.alias("status"))
