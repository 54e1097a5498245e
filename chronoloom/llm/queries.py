"""Queries p2, p3, p7, p8 and p9, with the SQL that states their results where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoloom.functions.duration import hours
from chronoloom.llm import contamination, mixing, percentiles, residue, runs
from chronoloom.operators import shards
from chronoloom.operators.staging import dimension, staged
from chronoloom.sources.tables import table
from chronoloom.timeseries_queries import READINGS_SQL


def _tag_groups(spark: SparkSession, folder: str, kind: str | None) -> DataFrame:
    """``series_id, metric_name, group_by, group_value, group_id`` of the saved queries, of one kind of metric or of all."""
    pairs = table(spark, folder, "query_specs").select("metric_name", "group_by").distinct()
    if kind is not None:
        of_kind = table(spark, folder, "metric_info").where(F.col("kind") == kind).select(F.col("metric").alias("metric_name"))
        pairs = pairs.join(of_kind, "metric_name", "left_semi")
    tagged = table(spark, folder, "series").select("series_id", F.col("metric").alias("metric_name"), F.explode("tags").alias("group_by", "group_value"))
    found = tagged.join(pairs, ["metric_name", "group_by"], "left_semi").where("group_value IS NOT NULL")
    return found.withColumn("group_id", F.to_json(F.struct("metric_name", "group_by", "group_value")))


def _selected(spark: SparkSession, folder: str, wanted: tuple[float, ...], kind: str | None = "sample") -> DataFrame:
    groups = dimension(_tag_groups(spark, folder, kind))
    pieces = staged(percentiles.reading_pieces(table(spark, folder, "points"), groups.select("series_id").distinct()))
    chosen = percentiles.multi_select(pieces, groups, wanted)
    names = groups.select("group_id", "metric_name", "group_by", "group_value").distinct()
    return chosen.join(names, "group_id")


PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def p2_percentiles_all(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of every saved pair of metric and tag, whatever the metric's kind."""
    return _selected(spark, folder, PERCENTILES, None).select("metric_name", "group_by", "group_value", "percentile", "value", "n")


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """The part of :func:`p2_percentiles_all` its SQL states: metrics of kind sample."""
    return _selected(spark, folder, PERCENTILES).select("metric_name", "group_by", "group_value", "percentile", "value", "n")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    wide = _selected(spark, folder, (0.5, 0.99)).groupBy("metric_name", "group_by", "group_value").agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("percentile") == 0.5, F.col("value"))).alias("p50"),
        F.max(F.when(F.col("percentile") == 0.99, F.col("value"))).alias("p99"),
    )
    return wide.where((F.col("n") >= 500) & (F.col("p99") > 10 * F.col("p50"))).select("metric_name", "group_by", "group_value")


def p3_runs_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every run as one event; a reading that repeats nothing is a run of 1."""
    described = shards.kind_of_series(table(spark, folder, "series"), table(spark, folder, "metric_info"), "state")
    return runs.collapse_runs(table(spark, folder, "points"), described)


def p3_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The part of :func:`p3_runs_all` its SQL states: runs of at least 3 readings."""
    return p3_runs_all(spark, folder).where("n >= 3")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_runs(spark, folder).select("series_id", "start_ns", "end_ns")


ANCHOR_GAP_NS = hours(6)


def p3_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of events within the tolerance of its first one, without a gap of more than 6 hours."""
    described = shards.kind_of_series(table(spark, folder, "series"), table(spark, folder, "metric_info"), "state")
    return runs.collapse_runs(table(spark, folder, "points"), described, compare="anchor", max_gap_ns=ANCHOR_GAP_NS)


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).where("exact").select("doc_id", "item_id")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = staged(mixing.keyed_records(table(spark, folder, "documents"), weight=mixing.quality_weight(F.col("align_score"))))
    return records, mixing.source_plan(records, table(spark, folder, "mix_targets"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(*_mix(spark, folder))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    records, plan = _mix(spark, folder)
    return mixing.actual_shares(mixing.mixture(records, plan), plan)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_shares(spark, folder).where("short").select("source")


def p9_residue(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_documents(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_residue(spark, folder).select("doc_id")


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    return residue.without_residue(table(spark, folder, "documents")).select("doc_id", "source", "lang")


_ANY_KIND = READINGS_SQL.replace("WHERE k.kind = '{kind}'", "")

_GROUPED = """,
pairs AS (SELECT DISTINCT metric_name, group_by FROM query_specs),
members AS (
  SELECT s.series_id, p.metric_name, p.group_by, t.value AS group_value
  FROM (SELECT series_id, metric, unnest(map_entries(tags)) AS t FROM series) s JOIN pairs p ON s.metric = p.metric_name AND s.t.key = p.group_by
),
grouped AS (SELECT m.metric_name, m.group_by, m.group_value, r.value FROM readings r JOIN members m USING (series_id))
"""
_SAMPLES = "WITH " + READINGS_SQL.format(kind="sample") + _GROUPED
_PERCENTILES = """
SELECT metric_name, group_by, group_value, percentile, sorted[greatest(1, ceil(percentile * n))::BIGINT] AS value, n
FROM (SELECT metric_name, group_by, group_value, list_sort(list(value)) AS sorted, count(*) AS n FROM grouped GROUP BY ALL),
  (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS percentile)
"""

_RUNS = (
    "WITH "
    + READINGS_SQL.format(kind="state")
    + """,
stepped AS (
  SELECT r.series_id, r.ts_ns, r.value, CASE WHEN lag(r.value) OVER w = r.value OR abs(r.value - lag(r.value) OVER w) <= k.tolerance THEN 0 ELSE 1 END AS fresh
  FROM readings r JOIN kinds k USING (series_id) WINDOW w AS (PARTITION BY r.series_id ORDER BY r.ts_ns)
),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY ts_ns) AS run FROM stepped)
"""
)

# row by row: a is the value of the open run's first reading
_ANCHORED = f"""
WITH RECURSIVE {READINGS_SQL.format(kind="state")},
p AS MATERIALIZED (SELECT r.series_id, r.ts_ns, r.value, k.tolerance, row_number() OVER (PARTITION BY r.series_id ORDER BY r.ts_ns) AS i FROM readings r JOIN kinds k USING (series_id)),
fold AS (
  SELECT series_id, i, ts_ns, value AS a, ts_ns AS start_ns FROM p WHERE i = 1
  UNION ALL
  SELECT p.series_id, p.i, p.ts_ns,
    CASE WHEN (p.value = o.a OR abs(p.value - o.a) <= p.tolerance) AND p.ts_ns - o.ts_ns <= {ANCHOR_GAP_NS} THEN o.a ELSE p.value END,
    CASE WHEN (p.value = o.a OR abs(p.value - o.a) <= p.tolerance) AND p.ts_ns - o.ts_ns <= {ANCHOR_GAP_NS} THEN o.start_ns ELSE p.ts_ns END
  FROM fold o JOIN p ON p.series_id = o.series_id AND p.i = o.i + 1
)
SELECT series_id, start_ns, max(ts_ns) AS end_ns, count(*) AS n, max(a) AS value, max(ts_ns) - start_ns AS duration_ns FROM fold GROUP BY series_id, start_ns
"""

_EVENTS = "SELECT series_id, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS n, arg_min(value, ts_ns) AS value, max(ts_ns) - min(ts_ns) AS duration_ns FROM numbered GROUP BY series_id, run"

SQL = {
    "p2_percentiles": _SAMPLES + _PERCENTILES,
    "p2_percentiles_all": "WITH " + _ANY_KIND + _GROUPED + _PERCENTILES,
    "p2_found": _SAMPLES
    + """
SELECT metric_name, group_by, group_value FROM grouped GROUP BY ALL
HAVING count(*) >= 500 AND quantile_disc(value, 0.99) > 10 * quantile_disc(value, 0.5)
""",
    "p3_runs": _RUNS + _EVENTS + " HAVING count(*) >= 3",
    "p3_runs_all": _RUNS + _EVENTS,
    "p3_anchor": _ANCHORED,
    "p3_found": _RUNS + "SELECT series_id, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM numbered GROUP BY series_id, run HAVING count(*) >= 3",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_percentiles, p2_percentiles_all, p3_found, p3_runs, p3_runs_all, p3_anchor, p7_found, p7_leaks, p8_found, p8_mixture, p8_shares, p9_found, p9_residue, p9_clean)}
