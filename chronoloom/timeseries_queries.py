"""Queries p1, p4, p5 and p6 over the stored points, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoloom.operators import grid, hotkeys, rolling, shards, spikes
from chronoloom.operators.staging import staged
from chronoloom.sources.tables import table


def _of_kind(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return shards.kind_of_series(table(spark, folder, "series"), table(spark, folder, "metric_info"), kind)


def _rolled(spark: SparkSession, folder: str, from_day: int | None = None) -> DataFrame:
    readings = shards.current_readings(table(spark, folder, "points"), _of_kind(spark, folder, "count"))
    return rolling.rolling_totals(staged(rolling.build_trees(rolling.daily_totals(readings))), from_day=from_day)


_PERIODS = ("total_7", "n_7", "per_day_7", "total_30", "n_30", "per_day_30")


def _with_means(rolled: DataFrame) -> DataFrame:
    return rolled.select("series_id", "day_no", *_PERIODS, *[F.round(f"mean_{p}", 6).alias(f"mean_{p}") for p in (7, 30)])


def p1_rolling_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every day from a series' first to its last, with all averages. Days before the first count as idle."""
    return _with_means(_rolled(spark, folder, from_day=0))


def p1_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`p1_rolling_all` from trees of the first nine tenths of all writes, corrected by the days of the later ones."""
    points, counted = table(spark, folder, "points"), _of_kind(spark, folder, "count")
    early = int((points.agg(F.max("ingest_seq")).first()[0] or 0) * 0.9)
    trees = staged(rolling.build_trees(rolling.daily_totals(shards.current_readings(points.where(F.col("ingest_seq") <= early), counted))))
    corrected = rolling.replace_days(trees, rolling.days_of_late_writes(points, counted, early))
    return _with_means(rolling.rolling_totals(staged(corrected), from_day=0))


def p1_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """The part of :func:`p1_rolling_all` its SQL states: days with 30 days of history, one average."""
    return _rolled(spark, folder).select("series_id", "day_no", "total_7", "n_7", "total_30", "n_30", F.round("mean_30", 6).alias("mean_30"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.busy_days(_rolled(spark, folder))


def p4_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged readings with their reason; an infinite value is given as null, so that both sides can be compared."""
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    return _flagged(spark, folder).withColumn("value", finite)


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible(table(spark, folder, "points"), _of_kind(spark, folder, "gauge"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _flagged(spark, folder).select("series_id", "ts_ns")


def p5_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The grid, rounded to 4 places, and fits of 100,000 and more, which readings far off make, to whole numbers.

    Stuck values often lie halfway between two rounded ones; a small shift takes them off it.
    """
    value = F.when(F.abs("value") < 1e5, F.round(F.col("value") + 1e-5, 4)).otherwise(F.round("value"))
    return _grid(spark, folder).withColumns({"value": value, "support": F.round("support", 4)})


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    return grid.regular_grid(table(spark, folder, "points"), _of_kind(spark, folder, "gauge"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).where("n_readings = 0").select("series_id", "start_ns")


def _tag_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "query_specs").select(F.col("group_by").alias("key_name"))


def p6_states(spark: SparkSession, folder: str) -> DataFrame:
    states = hotkeys.states_by_key(table(spark, folder, "points"), table(spark, folder, "series"), _tag_keys(spark, folder))
    return states.select("key_name", "key_value", "n_rows", "n_values", "first_ns", "last_ns")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = hotkeys.heavy_keys(table(spark, folder, "points"), table(spark, folder, "series"), _tag_keys(spark, folder))
    return found.select("key_name", "key_value")


#: The readings of the series of one kind, as common table expressions.
READINGS_SQL = """
kinds AS (SELECT s.series_id, m.* FROM series s JOIN metric_info m ON s.metric = m.metric),
newest AS (
  SELECT series_id, ts_ns, arg_max(value, ingest_seq) AS value
  FROM (SELECT p.series_id, p.ts_ns, p.ingest_seq, coalesce(p.value, 'nan'::DOUBLE) AS value FROM points p JOIN kinds k USING (series_id) WHERE k.kind = '{kind}')
  GROUP BY series_id, ts_ns
),
readings AS (SELECT series_id, ts_ns, value FROM newest WHERE NOT isnan(value))
"""

_ROLLED = (
    "WITH "
    + READINGS_SQL.format(kind="count")
    + """,
daily AS (SELECT series_id, ts_ns // 86400000000000 AS day_no, sum(value) AS total, count(*) AS n FROM readings GROUP BY 1, 2),
days AS (SELECT series_id, unnest(range(min(day_no), max(day_no) + 1)) AS day_no, min(day_no) AS first FROM daily GROUP BY series_id),
rolled AS (
  SELECT d.series_id, d.day_no, d.first,
    sum(coalesce(t.total, 0)) OVER (PARTITION BY d.series_id ORDER BY d.day_no ROWS 6 PRECEDING) AS total_7,
    sum(coalesce(t.n, 0)) OVER (PARTITION BY d.series_id ORDER BY d.day_no ROWS 6 PRECEDING)::BIGINT AS n_7,
    sum(coalesce(t.total, 0)) OVER (PARTITION BY d.series_id ORDER BY d.day_no ROWS 29 PRECEDING) AS total_30,
    sum(coalesce(t.n, 0)) OVER (PARTITION BY d.series_id ORDER BY d.day_no ROWS 29 PRECEDING)::BIGINT AS n_30
  FROM days d LEFT JOIN daily t USING (series_id, day_no)
)
"""
)

_WHOLE = (
    _ROLLED
    + """
SELECT series_id, day_no, total_7, n_7, total_7 / 7 AS per_day_7, total_30, n_30, total_30 / 30 AS per_day_30,
  CASE WHEN n_7 > 0 THEN round(total_7 / n_7, 6) END AS mean_7, CASE WHEN n_30 > 0 THEN round(total_30 / n_30, 6) END AS mean_30 FROM rolled
"""
)

# the operator's parameters: 8 readings and 64 steps on either side, fences 4.2, sketch buckets of 2 %, hours from 200 readings
_IMPLAUSIBLE = (
    "WITH "
    + READINGS_SQL.format(kind="gauge")
    + """,
r AS (
  SELECT r.series_id, r.ts_ns, r.value, k.lo, k.hi, 64 * k.step_ns AS reach, (r.ts_ns // 3600000000000) % 24 AS hour,
    NOT isinf(r.value) AND NOT coalesce(r.value < k.lo OR r.value > k.hi, false) AS possible
  FROM readings r JOIN kinds k USING (series_id)
),
around AS (
  SELECT *, lag(ts_ns) OVER o AS prev_ns, lag(value) OVER o AS prev,
    list(CASE WHEN possible THEN {'t': ts_ns, 'v': value} END) OVER (o ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS before,
    list(CASE WHEN possible THEN {'t': ts_ns, 'v': value} END) OVER (o ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS behind
  FROM r WINDOW o AS (PARTITION BY series_id ORDER BY ts_ns)
),
near AS (
  SELECT * EXCLUDE (before, behind),
    list_sort(list_transform(list_filter(before, lambda x: x IS NOT NULL AND ts_ns - x.t <= reach), lambda x: x.v)) AS b,
    list_sort(list_transform(list_filter(behind, lambda x: x IS NOT NULL AND x.t - ts_ns <= reach), lambda x: x.v)) AS a
  FROM around
),
sides AS (
  SELECT * EXCLUDE (a, b), CASE WHEN len(b) >= 2 THEN (b[(len(b) - 1) // 2 + 1] + b[len(b) // 2 + 1]) / 2 END AS l,
    CASE WHEN len(a) >= 2 THEN (a[(len(a) - 1) // 2 + 1] + a[len(a) // 2 + 1]) / 2 END AS g
  FROM near
),
features AS (SELECT *, CASE WHEN possible THEN value - coalesce((l + g) / 2, l, g) END AS residual FROM sides),
sketch AS (
  SELECT series_id, hour, CASE WHEN abs(residual) <= pow(2, -40) THEN 0 ELSE sign(residual) * greatest(1, ceil((ln(abs(residual)) + 40 * ln(2)) / ln(1.02))) END AS bucket, count(*) AS n
  FROM features WHERE residual IS NOT NULL GROUP BY ALL
),
ranked AS (
  SELECT series_id, hour, bucket, sum(n) OVER (PARTITION BY series_id, hour ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY series_id, hour) AS n_all FROM sketch
  UNION ALL
  SELECT series_id, NULL, bucket, sum(n) OVER (PARTITION BY series_id ORDER BY bucket), sum(n) OVER (PARTITION BY series_id)
  FROM (SELECT series_id, bucket, sum(n) AS n FROM sketch GROUP BY ALL)
),
quartiles AS (
  SELECT series_id, hour, min(v) FILTER (below * 4 >= n_all * 3) - min(v) FILTER (below * 4 >= n_all) AS iqr, max(n_all) AS n_all
  FROM (SELECT *, CASE WHEN bucket = 0 THEN 0 ELSE sign(bucket) * pow(1.02, abs(bucket) - 0.5) / pow(2, 40) END AS v FROM ranked) GROUP BY ALL
),
fences AS (
  SELECT h.series_id, h.hour, greatest(CASE WHEN h.n_all >= 200 THEN h.iqr END, s.iqr) AS iqr, s.iqr AS series_iqr
  FROM quartiles h JOIN quartiles s ON s.series_id = h.series_id AND s.hour IS NULL WHERE h.hour IS NOT NULL
),
judged AS (
  SELECT f.*, c.iqr, c.series_iqr, value - coalesce(l, g) AS off_l, value - coalesce(g, l) AS off_g
  FROM features f LEFT JOIN fences c USING (series_id, hour)
),
single AS (
  SELECT series_id, ts_ns, value, CASE WHEN NOT possible THEN 'physical'
    WHEN abs((off_l + off_g) / 2) > iqr * 4.7 AND least(off_l * sign((off_l + off_g) / 2), off_g * sign((off_l + off_g) / 2)) > abs((off_l + off_g) / 2) * 0.6 THEN 'rate' END AS reason
  FROM judged
),
steps AS (
  SELECT series_id, ts_ns, value, CASE WHEN abs(value - prev) <= series_iqr * 0.005 AND ts_ns - prev_ns <= reach THEN 0 ELSE 1 END AS fresh FROM judged
),
stretches AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY ts_ns) AS stretch FROM steps),
lengths AS (SELECT *, count(*) OVER (PARTITION BY series_id, stretch) AS n FROM stretches),
counted AS (SELECT series_id, n, count(*) // n AS times FROM lengths GROUP BY series_id, n),
upto AS (SELECT *, sum(times) OVER (PARTITION BY series_id ORDER BY n) AS upto, sum(times) OVER (PARTITION BY series_id) AS all_ FROM counted),
usual AS (SELECT series_id, min(n) FILTER (upto >= greatest(1, least(ceil(all_ * 0.99), all_ - 2))) AS usual FROM upto GROUP BY series_id),
stuck AS (SELECT series_id, ts_ns, value, 'stuck' AS reason FROM lengths JOIN usual USING (series_id) WHERE n >= 10 AND n >= usual * 2),
flags AS (SELECT series_id, ts_ns, value, min(reason) AS reason FROM (SELECT * FROM single WHERE reason IS NOT NULL UNION ALL SELECT * FROM stuck) GROUP BY ALL)
"""
)

# weighted sums over the readings of the cells around each cell, which lie within 2.5 steps of its middle
_GRID = (
    "WITH "
    + READINGS_SQL.format(kind="gauge")
    + """,
placed AS (SELECT r.series_id, k.step_ns, r.ts_ns // k.step_ns AS cell, (r.ts_ns % k.step_ns) / k.step_ns::DOUBLE AS part, r.value FROM readings r JOIN kinds k USING (series_id)),
cells AS (SELECT series_id, step_ns, unnest(range(min(cell), max(cell) + 1)) AS cell FROM placed GROUP BY series_id, step_ns),
own AS (SELECT series_id, cell, count(*) AS n FROM placed GROUP BY ALL),
pairs AS (
  SELECT series_id, cell - o AS cell, part + o - 0.5 AS x, value AS y, pow(1 - pow(abs((part + o - 0.5) / 2.5), 3), 3) AS w
  FROM placed, (SELECT unnest(range(-3, 4)) AS o) WHERE NOT isinf(value) AND abs(part + o - 0.5) < 2.5
),
sums AS (SELECT series_id, cell, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * y) AS t0, sum(w * x * y) AS t1, sum(w * w) AS sq FROM pairs GROUP BY ALL),
fits AS (
  SELECT c.series_id, c.cell * c.step_ns AS start_ns, coalesce(o.n, 0)::INTEGER AS n_readings, coalesce(s0 * s0 / sq, 0) AS support,
    CASE WHEN s0 * s0 / sq >= 1.5 THEN CASE WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END END AS value
  FROM cells c LEFT JOIN own o USING (series_id, cell) LEFT JOIN sums s USING (series_id, cell)
)
SELECT series_id, start_ns, CASE WHEN abs(value) < 1e5 THEN round(value + 1e-5, 4) ELSE round(value) END AS value, round(support, 4) AS support, n_readings,
  CASE WHEN n_readings > 0 THEN 'observed' WHEN value IS NOT NULL THEN 'filled' ELSE 'missing' END AS status FROM fits
"""
)

_STATES = """
WITH keyed AS (
  SELECT 'series_id' AS key_name, CAST(series_id AS VARCHAR) AS key_value, value, ts_ns FROM points WHERE series_id IS NOT NULL
  UNION ALL
  SELECT e.key_name, e.key_value, p.value, p.ts_ns FROM points p JOIN (
    SELECT series_id, unnest(map_entries(tags)).key AS key_name, unnest(map_entries(tags)).value AS key_value FROM series
  ) e USING (series_id) WHERE e.key_name IN (SELECT group_by FROM query_specs)
)
"""

SQL = {
    "p1_rolling": _ROLLED
    + "SELECT series_id, day_no, total_7, n_7, total_30, n_30, CASE WHEN n_30 > 0 THEN round(total_30 / n_30, 6) END AS mean_30 FROM rolled WHERE day_no >= first + 29",
    "p1_found": _ROLLED + "SELECT series_id, day_no FROM rolled WHERE day_no >= first + 29 AND 10 * total_7 > 7 * total_30",
    "p1_rolling_all": _WHOLE,
    "p1_corrected": _WHOLE,
    "p4_flags": _IMPLAUSIBLE + "SELECT series_id, ts_ns, CASE WHEN NOT isinf(value) THEN value END AS value, reason FROM flags",
    "p4_found": _IMPLAUSIBLE + "SELECT series_id, ts_ns FROM flags",
    "p5_grid": _GRID,
    "p5_found": "WITH "
    + READINGS_SQL.format(kind="gauge")
    + """,
cells AS (SELECT DISTINCT r.series_id, k.step_ns, r.ts_ns // k.step_ns AS cell FROM readings r JOIN kinds k USING (series_id)),
grid AS (SELECT series_id, step_ns, unnest(range(min(cell), max(cell) + 1)) AS cell FROM cells GROUP BY series_id, step_ns)
SELECT series_id, cell * step_ns AS start_ns FROM grid ANTI JOIN cells USING (series_id, cell)
""",
    "p6_states": _STATES
    + "SELECT key_name, key_value, count(*) AS n_rows, count(value) FILTER (WHERE NOT isnan(value)) AS n_values, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM keyed GROUP BY 1, 2",
    "p6_found": _STATES + "SELECT key_name, key_value FROM keyed GROUP BY 1, 2 HAVING count(*) * 50 >= (SELECT count(*) FROM points)",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_rolling, p1_rolling_all, p1_corrected, p4_found, p4_flags, p5_found, p5_grid, p6_found, p6_states)}
