"""Queries of the tagged time-series engine over the test tables, with the SQL that states their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoloom.functions.duration import UNITS, days, duration, hours, minutes, seconds, timestamp, years
from chronoloom.functions.names import is_metric_name, parse_tags_column, series_key_column
from chronoloom.operators import buckets, postings
from chronoloom.operators.staging import remove_at_exit, shared_folder, staged
from chronoloom.plans.query import Query
from chronoloom.sources.adapters import as_points_in, split_points
from chronoloom.sources.store import Database
from chronoloom.sources.tables import table

JANUARY_10, JANUARY_20 = 1_704_844_800_000_000_000, 1_705_708_800_000_000_000


def _events(spark: SparkSession, folder: str) -> Database:
    """Metric ``event.value`` with tags ``event_type`` and ``user``, an even user also with ``half:even``."""
    df = table(spark, folder, "events")
    half = F.when(F.col("user_id") % 2 == 0, F.lit("even"))
    tags = {"event_type": F.col("event_type"), "user": F.concat(F.lit("u-"), F.col("user_id")), "half": half}
    points, series = split_points(as_points_in(df, "event.value", F.col("ts"), F.col("value"), tags, F.col("event_id")))
    return Database.from_dataframes(points, series)


def _orders(spark: SparkSession, folder: str) -> Database:
    df = table(spark, folder, "orders")
    tags = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}
    points, series = split_points(as_points_in(df, "order.totalprice", F.col("o_orderdate"), F.col("o_totalprice"), tags, F.col("o_orderkey")))
    return Database.from_dataframes(points, series)


def _stored(spark: SparkSession, folder: str) -> Database:
    return Database.from_dataframes(table(spark, folder, "points"), table(spark, folder, "series"))


def _shown(query: Query) -> DataFrame:
    """Results with the columns' names and rounding of the SQL side."""
    named = query.to_df().withColumnsRenamed({"group": "grp", "start": "start_ns", "end": "end_ns"})
    return named.select("grp", "start_ns", "end_ns", F.round("value", 6).alias("value"), "len")


_AGG_SQL = {
    "avg": "avg(v)",
    "sum": "sum(v)",
    "min": "coalesce(min(v) FILTER (WHERE NOT isnan(v)), max(v))",
    "max": "coalesce(max(v) FILTER (WHERE NOT isnan(v)), max(v))",
    "count": "count(*)::DOUBLE",
}

_EVENTS = """
src AS (
  SELECT 'event.value' AS metric, event_type, 'u-' || user_id AS usr, CASE WHEN user_id % 2 = 0 THEN 'even' END AS half,
    epoch_ns(ts) AS ts, value AS v, event_id AS seq
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL
)
"""
_ORDERS = """
src AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, epoch_ns(o_orderdate::TIMESTAMP) AS ts, o_totalprice AS v, o_orderkey AS seq FROM orders)
"""


def _bucket_sql(source: str, series: str, group: str, where: str, width: int, agg: str) -> str:
    """Newest-anchored buckets: the recursion lists their ends, the join finds their points."""
    return f"""
WITH RECURSIVE {source},
newest AS (SELECT {group} AS g, ts, arg_max(struct_pack(x := v), seq).x AS v FROM src WHERE ({where}) AND {group} IS NOT NULL GROUP BY {group}, {series}, ts),
p AS (SELECT * FROM newest WHERE v IS NOT NULL),
times AS (SELECT DISTINCT g, ts FROM p),
steps AS MATERIALIZED (SELECT a.g, a.ts, b.ts AS older FROM times a ASOF LEFT JOIN times b ON a.g = b.g AND a.ts - {width} > b.ts),
ends AS (
  SELECT g, max(ts) AS e FROM p GROUP BY g
  UNION ALL
  SELECT s.g, s.older FROM ends o JOIN steps s ON s.g = o.g AND s.ts = o.e WHERE s.older IS NOT NULL
)
SELECT e.g AS grp, min(p.ts) AS start_ns, e.e AS end_ns, round({_AGG_SQL[agg]}, 6) AS value, count(*) AS len
FROM p ASOF JOIN ends e ON p.g = e.g AND p.ts <= e.e GROUP BY e.g, e.e
"""


_SERIES_OF = {_EVENTS: "event_type, usr, half", _ORDERS: "status, priority"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


def _add_buckets(
    name: str,
    agg: str,
    group: str,
    width: int,
    refine: Callable[[Query], Query] = lambda q: q,
    where: str = "true",
    source: str = _EVENTS,
) -> None:
    database, metric = (_events, "event.value") if source is _EVENTS else (_orders, "order.totalprice")

    def build(spark: SparkSession, folder: str) -> DataFrame:
        return _shown(refine(getattr(database(spark, folder), agg)(metric, group).granularity(width)))

    _add(name, build, _bucket_sql(source, _SERIES_OF[source], group, where, width, agg))


for _agg in buckets.AGGREGATES:
    _add_buckets(f"{_agg}_hour_by_event_type", _agg, "event_type", hours(1))

for _name, _text, _where in (
    ("filter_all", "*", "true"),
    ("filter_eq", "event_type:click", "event_type = 'click'"),
    ("filter_wildcard", "user:u-1*", "usr LIKE 'u-1%'"),
    ("filter_has_key", "half:*", "half IS NOT NULL"),
    ("filter_and", "half:even AND user:u-1*", "half = 'even' AND usr LIKE 'u-1%'"),
    ("filter_or", "user:u-1 OR user:u-2*", "usr = 'u-1' OR usr LIKE 'u-2%'"),
    ("filter_not", "!half:even", "coalesce(half, '') <> 'even'"),
    ("filter_nested", "!(half:even AND (user:u-1* OR user:u-2*)) AND user:u-*", "NOT (coalesce(half, '') = 'even' AND (usr LIKE 'u-1%' OR usr LIKE 'u-2%'))"),
    ("filter_set", "user:[u-1, u-12,u-123]", "usr IN ('u-1', 'u-12', 'u-123')"),
):
    _add_buckets(_name, "avg", "event_type", hours(6), lambda q, t=_text: q.filter(t).with_options(sets=True), _where)

_add_buckets("range_start", "sum", "event_type", hours(6), lambda q: q.start(JANUARY_10), f"ts >= {JANUARY_10}")
_add_buckets("range_end", "sum", "event_type", hours(6), lambda q: q.end(JANUARY_20), f"ts <= {JANUARY_20}")
_add_buckets("range_both", "sum", "event_type", hours(6), lambda q: q.start(JANUARY_10).end(JANUARY_20), f"ts BETWEEN {JANUARY_10} AND {JANUARY_20}")
_add_buckets("range_single_bucket", "avg", "event_type", days(30), lambda q: q.start(JANUARY_10).end(JANUARY_20), f"ts BETWEEN {JANUARY_10} AND {JANUARY_20}")
_add_buckets("group_missing_tag", "count", "half", hours(6))
_add_buckets("multi_series_group", "max", "event_type", minutes(30), lambda q: q.filter("user:u-*"))
_add_buckets("default_minute_granularity", "count", "event_type", minutes(1))
_add_buckets("zero_width", "sum", "event_type", 0)
_add_buckets("upsert_last_write_wins", "sum", "status", days(7), source=_ORDERS)
_add_buckets("filter_wildcard_space", "avg", "status", days(7), lambda q: q.filter("priority:4-NOT*"), "priority LIKE '4-NOT%'", source=_ORDERS)


def bucket_len_bounds_middle(spark: SparkSession, folder: str) -> DataFrame:
    result = _events(spark, folder).count("event.value", "event_type").granularity(hours(1)).to_df()
    return result.select(F.col("group").alias("grp"), F.col("start").alias("start_ns"), F.col("end").alias("end_ns"), buckets.middle().alias("middle_ns"), "len")


_add(
    "bucket_len_bounds_middle",
    bucket_len_bounds_middle,
    f"SELECT grp, start_ns, end_ns, start_ns + (end_ns - start_ns) // 2 AS middle_ns, len FROM ({_bucket_sql(_EVENTS, _SERIES_OF[_EVENTS], 'event_type', 'true', hours(1), 'count')})",
)


def boundary_drop(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_events(spark, folder).sum("event.value", "event_type").granularity(hours(6)).with_options(boundary="drop"))


# rows in order of time, newest first; the bucket of row i ends before the first row that is too old, which is lost
_add(
    "boundary_drop",
    boundary_drop,
    f"""
WITH RECURSIVE {_EVENTS},
p AS (SELECT event_type AS g, ts, v, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS i FROM src),
steps AS MATERIALIZED (SELECT a.g, a.i, a.ts, b.i AS closing FROM p a ASOF LEFT JOIN p b ON a.g = b.g AND a.ts - {hours(6)} > b.ts),
opens AS (
  SELECT g, i, ts, closing FROM steps WHERE i = 1
  UNION ALL
  SELECT s.g, s.i, s.ts, s.closing FROM opens o JOIN steps s ON s.g = o.g AND s.i = o.closing + 1
)
SELECT o.g AS grp, min(p.ts) AS start_ns, o.ts AS end_ns, round(sum(p.v), 6) AS value, count(*) AS len
FROM opens o JOIN p ON p.g = o.g AND p.i >= o.i AND p.i < coalesce(o.closing, 1000000000) GROUP BY o.g, o.i, o.ts
""",
)


def series_order_drop(spark: SparkSession, folder: str) -> DataFrame:
    """The historical reading order and loss together."""
    return _shown(_events(spark, folder).sum("event.value", "event_type").granularity(hours(6)).with_options(boundary="drop", order="series"))


# one row after the other: e is the newest time of the open bucket, null behind the row that closed it, which is lost
_add(
    "series_order_drop",
    series_order_drop,
    f"""
WITH RECURSIVE {_EVENTS},
turns AS (SELECT *, max(ts) OVER (PARTITION BY event_type, usr, half) AS turn FROM src),
p AS MATERIALIZED (SELECT event_type AS g, ts, v, row_number() OVER (PARTITION BY event_type ORDER BY turn, usr, half, ts DESC) AS i FROM turns),
fold AS (
  SELECT g, i, ts, v, ts AS e, 1 AS bucket, true AS kept FROM p WHERE i = 1
  UNION ALL
  SELECT p.g, p.i, p.ts, p.v,
    CASE WHEN o.e IS NULL THEN p.ts WHEN p.ts > o.e OR p.ts < o.e - {hours(6)} THEN NULL ELSE o.e END,
    o.bucket + CASE WHEN o.e IS NULL THEN 1 ELSE 0 END, o.e IS NULL OR NOT (p.ts > o.e OR p.ts < o.e - {hours(6)})
  FROM fold o JOIN p ON p.g = o.g AND p.i = o.i + 1
)
SELECT g AS grp, min(ts) AS start_ns, max(ts) AS end_ns, round(sum(v), 6) AS value, count(*) AS len FROM fold WHERE kept GROUP BY g, bucket
""",
)


def series_catalog(spark: SparkSession, folder: str) -> DataFrame:
    series = _events(spark, folder).series()
    return series.select("metric", "series_key", F.size("tags").alias("n_tags"))


_EVENT_SERIES = f"""
WITH {_EVENTS}, s AS (
  SELECT DISTINCT 'event.value' AS metric, event_type, half, usr,
    'event.value#event_type:' || event_type || coalesce(';half:' || half, '') || ';user:' || usr AS series_key FROM src
)
"""
_add("series_catalog", series_catalog, _EVENT_SERIES + "SELECT metric, series_key, CASE WHEN half IS NULL THEN 2 ELSE 3 END AS n_tags FROM s")


def tag_index_postings(spark: SparkSession, folder: str) -> DataFrame:
    index = postings.tag_index(_events(spark, folder).series())
    return postings.posting_lists(index).groupBy("term").agg(F.sum(F.size("series_ids")).alias("n_series"))


_add(
    "tag_index_postings",
    tag_index_postings,
    _EVENT_SERIES
    + """
SELECT term, count(*) AS n_series FROM (
  SELECT 'event.value#event_type:' || event_type AS term FROM s
  UNION ALL SELECT 'event.value#user:' || usr FROM s
  UNION ALL SELECT 'event.value#half:' || half FROM s WHERE half IS NOT NULL
) GROUP BY term
""",
)


def tag_index_table(spark: SparkSession, folder: str) -> DataFrame:
    return postings.tag_index(table(spark, folder, "series"))


_add("tag_index_table", tag_index_table, "SELECT DISTINCT metric, key, value, series_id FROM tag_index")


def series_key_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "series").select("series_id", series_key_column(F.col("metric"), F.col("tags")).alias("series_key"))


_add(
    "series_key_text",
    series_key_text,
    """
SELECT series_id, metric || '#' || coalesce(array_to_string(list_sort(list_transform(map_entries(tags), lambda e: e.key || ':' || e.value)), ';'), '') AS series_key FROM series
""",
)


def _postings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    series = table(spark, folder, "series")
    index = staged(postings.tag_index(series))
    return series.select("series_id"), postings.query_eq(index, "request.latency", "env", "prod"), postings.query_prefix(index, "request.latency", "service", "db.")


_LISTS = """
WITH one AS (SELECT DISTINCT series_id FROM tag_index WHERE metric = 'request.latency' AND key = 'env' AND value = 'prod'),
two AS (SELECT DISTINCT series_id FROM tag_index WHERE metric = 'request.latency' AND key = 'service' AND value LIKE 'db.%')
"""


def postings_intersection(spark: SparkSession, folder: str) -> DataFrame:
    _, one, two = _postings(spark, folder)
    return postings.intersection(one, two)


def postings_union(spark: SparkSession, folder: str) -> DataFrame:
    _, one, two = _postings(spark, folder)
    return postings.union(one, two)


def postings_complement(spark: SparkSession, folder: str) -> DataFrame:
    everything, one, two = _postings(spark, folder)
    return postings.complement(everything, one, two)


_add("postings_intersection", postings_intersection, _LISTS + "SELECT * FROM one INTERSECT SELECT * FROM two")
_add("postings_union", postings_union, _LISTS + "SELECT * FROM one UNION SELECT * FROM two")
_add("postings_complement", postings_complement, _LISTS + "SELECT DISTINCT series_id FROM series EXCEPT SELECT * FROM one EXCEPT SELECT * FROM two")


def _saved(number: int) -> Callable[[SparkSession, str], DataFrame]:
    def saved(spark: SparkSession, folder: str) -> DataFrame:
        spec = table(spark, folder, "query_specs").where(F.col("query_id") == number).first()
        query: Query = getattr(_stored(spark, folder), spec["agg"])(spec["metric_name"], spec["group_by"]).granularity(spec["bucket_width_ns"])
        query = query.filter(spec["filter_expr"])
        query = query if spec["min_ts_ns"] is None else query.start(spec["min_ts_ns"])
        return _shown(query if spec["max_ts_ns"] is None else query.end(spec["max_ts_ns"]))

    return saved


def _saved_sql(agg: str, metric: str, key: str, width: int, where: str = "true", bounds: str = "true") -> str:
    source = f"""
src AS (
  SELECT p.series_id, p.ts_ns AS ts, p.value AS v, p.ingest_seq AS seq, element_at(s.tags, '{key}')[1] AS g0
  FROM points p JOIN series s USING (series_id) WHERE s.metric = '{metric}' AND ({where}) AND ({bounds})
)
"""
    return _bucket_sql(source, "series_id", "g0", "true", width, agg)


def _tag(key: str) -> str:
    return f"coalesce(element_at(s.tags, '{key}')[1], '')"


# the saved queries of the test tables, written out
for _number, _sql in {
    1: _saved_sql("avg", "cpu.load", "host", minutes(20), bounds="p.ts_ns <= 1722124800000000000"),
    2: _saved_sql("avg", "mem.used_pct", "host", minutes(20)),
    3: _saved_sql("avg", "disk.temp", "host", minutes(100), bounds="p.ts_ns >= 1705881600000000000"),
    4: _saved_sql("avg", "fan.rpm", "host", minutes(40)),
    5: _saved_sql("avg", "link.rtt_ms", "host", minutes(10), bounds="p.ts_ns <= 1725235200000000000"),
    6: _saved_sql("avg", "room.humidity", "host", minutes(200), bounds="p.ts_ns >= 1707696000000000000"),
    7: _saved_sql("max", "request.latency", "service", minutes(1), f"{_tag('env')} = 'prod'"),
    8: _saved_sql("avg", "request.latency", "host", minutes(1)),
    9: _saved_sql("sum", "query.rows", "service", hours(1), f"{_tag('service')} LIKE 'db.%'", "p.ts_ns BETWEEN 1709510400000000000 AND 1728345600000000000"),
    10: _saved_sql("avg", "query.rows", "route", hours(1)),
    11: _saved_sql("sum", "payload.bytes", "service", days(1)),
    12: _saved_sql("sum", "payload.bytes", "host", days(1), f"{_tag('env')} = 'prod' AND {_tag('route')} <> 'probe'", "p.ts_ns >= 1711324800000000000"),
    13: _saved_sql("sum", "jobs.done", "service", days(1), f"{_tag('env')} IN ('prod', 'staging')", "p.ts_ns <= 1731456000000000000"),
    14: _saved_sql("sum", "mails.queued", "service", days(1), f"{_tag('service')} = 'mailer'"),
    15: _saved_sql("sum", "logins.total", "env", days(7), f"{_tag('env')} NOT IN ('test', 'dev')", "p.ts_ns >= 1713139200000000000"),
    16: _saved_sql("count", "node.state", "zone", hours(1), f"{_tag('zone')} LIKE 'north-%'"),
    17: _saved_sql("max", "breaker.code", "zone", hours(1), f"{_tag('rack')} <> ''", "p.ts_ns <= 1734566400000000000"),
    18: _saved_sql("min", "door.angle", "zone", hours(1), bounds="p.ts_ns >= 1714953600000000000"),
    19: _saved_sql("max", "cpu.load", "zone", minutes(5), f"{_tag('service')} LIKE 'db.postgres.%'"),
    20: _saved_sql("min", "disk.temp", "rack", minutes(5)),
    21: _saved_sql("count", "request.latency", "service", minutes(1), f"{_tag('service')} LIKE 'queue.%'", "p.ts_ns BETWEEN 1716768000000000000 AND 1737676800000000000"),
    22: _saved_sql("sum", "logins.total", "owner", days(1)),
}.items():
    _add(f"saved_query_{_number}", _saved(_number), _sql)


# -- bounds that are relative to now, negation over all metrics, lazy groups


_add_buckets("range_relative_start", "sum", "event_type", hours(6), lambda q: q.start_relative(timestamp() - JANUARY_10 + 1), f"ts >= {JANUARY_10}")
_add_buckets("range_relative_end", "sum", "event_type", hours(6), lambda q: q.end_relative(timestamp() - JANUARY_20), f"ts <= {JANUARY_20}")
_add_buckets("range_relative_wide", "count", "event_type", days(1), lambda q: q.start_relative(years(60)).end_relative(0))


def not_scope_db(spark: SparkSession, folder: str) -> DataFrame:
    """A negation that reaches the series of all metrics."""
    query = _stored(spark, folder).count("node.state", "zone").filter("!zone:north-*").with_options(not_scope="db").granularity(days(7))
    return _shown(query)


_add(
    "not_scope_db",
    not_scope_db,
    _bucket_sql(
        f"""
src AS (
  SELECT p.series_id, p.ts_ns AS ts, p.value AS v, p.ingest_seq AS seq, element_at(s.tags, 'zone')[1] AS g0
  FROM points p JOIN series s USING (series_id) WHERE {_tag("zone")} NOT LIKE 'north-%'
)
""",
        "series_id", "g0", "true", days(7), "count",
    ),
)


def lazy_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The groups of a result one by one, those without points too: how many buckets and points each has."""
    groups = _events(spark, folder).count("event.value", "event_type").granularity(hours(6)).start(JANUARY_10).filter("half:even").build()
    found = [(name, sum(1 for _ in groups[name]), sum(b.len for b in groups[name]), next((b.end for b in groups[name]), None)) for name in groups]
    return spark.createDataFrame(found, "grp STRING, n_buckets BIGINT, n_points BIGINT, newest_ns BIGINT")


_add(
    "lazy_groups",
    lazy_groups,
    f"SELECT grp, count(*) AS n_buckets, sum(len)::BIGINT AS n_points, max(end_ns) AS newest_ns FROM ({_bucket_sql(_EVENTS, _SERIES_OF[_EVENTS], 'event_type', f'half = {chr(39)}even{chr(39)} AND ts >= {JANUARY_10}', hours(6), 'count')}) GROUP BY grp",
)


# -- the write path


def _written(spark: SparkSession, folder: str) -> Database:
    """The points of two metrics written into a new store in two batches, the later half of the writes first."""
    path = f"{shared_folder(spark)}/chronoloom-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    db = Database.builder(spark).hyper_mode(True).open(path)
    tagged = table(spark, folder, "points").where("value IS NOT NULL AND ts_ns >= 0").drop("metric")
    tagged = tagged.join(table(spark, folder, "series").where("metric IN ('cpu.load', 'node.state')"), "series_id").select("metric", "ts_ns", "value", "tags", "ingest_seq")
    for part in ("ingest_seq % 2 = 1", "ingest_seq % 2 = 0"):
        db.write_df(tagged.where(part))
    return Database.open(spark, path)


_WRITTEN = """
src AS (
  SELECT s.series_key, s.metric, p.ts_ns AS ts, p.value AS v, p.ingest_seq AS seq, element_at(s.tags, 'host')[1] AS host
  FROM points p JOIN series s USING (series_id) WHERE s.metric IN ('cpu.load', 'node.state') AND p.value IS NOT NULL
)
"""


def store_reopened(spark: SparkSession, folder: str) -> DataFrame:
    """A query of a store written in two batches and opened again."""
    return _shown(_written(spark, folder).max("cpu.load", "host").granularity(hours(1)).filter("!host:h-1"))


_add("store_reopened", store_reopened, _bucket_sql(_WRITTEN, "series_key", "host", "metric = 'cpu.load' AND host <> 'h-1'", hours(1), "max"))


def store_series(spark: SparkSession, folder: str) -> DataFrame:
    """The series registered by writing, each once."""
    return _written(spark, folder).series().select("metric", "series_key", F.size("tags").alias("n_tags"))


_add(
    "store_series",
    store_series,
    """
SELECT DISTINCT s.metric, s.metric || '#' || coalesce(array_to_string(list_sort(list_transform(map_entries(tags), lambda e: e.key || ':' || e.value)), ';'), '') AS series_key,
  coalesce(cardinality(tags), 0)::INTEGER AS n_tags
FROM series s WHERE s.metric IN ('cpu.load', 'node.state') AND series_id IN (SELECT series_id FROM points WHERE value IS NOT NULL)
""",
)


def store_point_writes(spark: SparkSession, folder: str) -> DataFrame:
    """Single writes and overwrites through ``write_at`` in hyper mode, flushed, compacted and read again."""
    path = f"{shared_folder(spark)}/chronoloom-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    db = Database.builder(spark).hyper_mode(True).open(f"{path}/a")
    for row in table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").toLocalIterator():
        for again in (0, 1):
            tags = {"region": str(row["n_regionkey"])}
            db.write_at("nation.name", (row["n_nationkey"] + 1) * 1_000_000_000, float(len(row["n_name"]) + again), tags)
    db.flush()
    return _shown(db.compact(f"{path}/b").sum("nation.name", "region").granularity(seconds(3)))


_add(
    "store_point_writes",
    store_point_writes,
    _bucket_sql(
        "src AS (SELECT n_regionkey::VARCHAR AS region, (n_nationkey::BIGINT + 1) * 1000000000 AS ts, (length(n_name) + 1)::DOUBLE AS v, 1 AS seq FROM nation)",
        "region", "region", "true", seconds(3), "sum",
    ),
)


# -- names, tags, durations


def tags_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """The tags of each series read back from the text of its key."""
    keys = table(spark, folder, "series").select("series_id", series_key_column(F.col("metric"), F.col("tags")).alias("k"))
    return keys.select("series_id", F.explode(parse_tags_column(F.regexp_replace("k", "^[^#]*#", ""))).alias("key", "value"))


_add("tags_parsed", tags_parsed, "SELECT series_id, unnest(map_entries(tags)).key AS key, unnest(map_entries(tags)).value AS value FROM series WHERE tags IS NOT NULL")


def metric_names(spark: SparkSession, folder: str) -> DataFrame:
    """The rule for metric names over the texts of a column."""
    names = table(spark, folder, "metric_info").select("metric").unionByName(table(spark, folder, "part").select(F.col("p_type").alias("metric"))).distinct()
    return names.select("metric", is_metric_name(F.col("metric")).alias("valid"))


_add("metric_names", metric_names, "SELECT DISTINCT metric, regexp_full_match(metric, '[a-z_.]+') AS valid FROM (SELECT metric FROM metric_info UNION ALL SELECT p_type FROM part)")


def durations(spark: SparkSession, folder: str) -> DataFrame:
    """Every unit, whole and with a fraction."""
    rows = [(unit, n, duration(n, unit)) for unit in UNITS for n in (1.0, 2.5, -1.0)]
    return spark.createDataFrame(rows, "unit STRING, n DOUBLE, ns BIGINT")


_add(
    "durations",
    durations,
    """
SELECT unit, n, CASE WHEN n > 0 THEN trunc(n * ns)::BIGINT ELSE 0 END AS ns
FROM (VALUES ('nanos', 1), ('micros', 1000), ('millis', 1000000), ('seconds', 1000000000), ('minutes', 60000000000), ('hours', 3600000000000), ('days', 86400000000000),
  ('weeks', 604800000000000), ('months', 2419200000000000), ('years', 29030400000000000)) u(unit, ns), (VALUES (1.0::DOUBLE), (2.5), (-1.0)) t(n)
""",
)
