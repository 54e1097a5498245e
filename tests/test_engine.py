import math

import pytest
from pyspark.sql import functions as F

from chronoloom.errors import InvalidQuery, StorageError
from chronoloom.functions.duration import days, timestamp
from chronoloom.operators import postings
from chronoloom.plans.query import Bucket
from chronoloom.sources.store import Database


def database(spark, rows, metric="hello"):
    """rows: (tags, ts, value) in order of writing; a fourth field names another metric."""
    from chronoloom.sources.adapters import split_points

    given = [(r[3] if len(r) > 3 else metric, r[1], r[2], r[0], i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(given, "metric STRING, ts_ns BIGINT, value DOUBLE, tags MAP<STRING,STRING>, ingest_seq BIGINT")
    return Database.from_dataframes(*split_points(df))


SOLO = [({"service": "one"}, t, float(v)) for t, v in enumerate((4, 10, 6, 10, 20))]
TWO = SOLO + [({"service": "two"}, 5, 7.0), ({"service": "two"}, 6, 5.0)]


def test_bounds(spark):
    db = database(spark, SOLO)
    for refine, expected in (
        (lambda q: q.start(2), Bucket(2, 4, 3.0, 3)),
        (lambda q: q.end(3), Bucket(0, 3, 4.0, 4)),
        (lambda q: q.start(1).end(3), Bucket(1, 3, 3.0, 3)),
    ):
        assert refine(db.count("hello", "service")).collect() == {"one": [expected]}
    assert db.count("hello", "service").start(3).end(1).collect() == {"one": []}


@pytest.mark.parametrize("agg, one, two", [("count", 5, 2), ("max", 20, 7), ("min", 4, 5), ("sum", 50, 12), ("avg", 10, 6)])
def test_aggregates(spark, agg, one, two):
    got = getattr(database(spark, TWO), agg)("hello", "service").collect()
    assert got == {"one": [Bucket(0, 4, float(one), 5)], "two": [Bucket(5, 6, float(two), 2)]}


def test_wildcards(spark):
    services = ["server.nginx", "db.bigtable", "db.neon", "db.postgres.14", "db.postgres.15", "db.postgres.16"]
    db = database(spark, [({"env": "prod", "service": s}, 0, 4.0) for s in services])
    for text, n in ((None, 6), ("service:db.postgres.16", 1), ("service:db.postgres.*", 3), ("service:db.*", 5), ("service:*", 6)):
        assert db.count("hello", "env").filter(text).collect()["prod"][0].len == n


def test_lossless_dropping_and_interleaved(spark):
    db = database(spark, [({"a": "x"}, t, float(v)) for t, v in ((100, 1), (99, 2), (95, 3), (90, 4), (89, 5), (50, 6))])
    query = db.sum("hello", "a").granularity(5)
    assert query.collect()["x"] == [Bucket(95, 100, 6.0, 3), Bucket(89, 90, 9.0, 2), Bucket(50, 50, 6.0, 1)]
    assert query.with_options(boundary="drop").collect()["x"] == [Bucket(95, 100, 6.0, 3), Bucket(89, 89, 5.0, 1)]
    rows = [({"g": "x", "s": "a"}, t, float(v)) for t, v in ((10, 1), (8, 2), (6, 3))] + [({"g": "x", "s": "b"}, t, float(v)) for t, v in ((9, 10), (7, 20), (5, 30))]
    both = database(spark, rows).sum("hello", "g").granularity(60)
    assert both.collect()["x"] == [Bucket(5, 10, 66.0, 6)]
    strict = both.with_options(boundary="drop", order="series").collect()["x"]
    assert sorted(strict, key=lambda b: b.end) == [Bucket(6, 8, 5.0, 2), Bucket(5, 9, 60.0, 3)]


def test_negation(spark):
    db = database(spark, [({"a": "b"}, 1, 1.0), ({"a": "c"}, 2, 1.0), ({"env": "x"}, 3, 1.0), ({"a": "d"}, 4, 1.0, "other")])
    query = db.count("hello", "a").filter("!a:b")
    assert set(query.collect()) == {"c"}
    assert set(query.with_options(not_scope="db").collect()) == {"c", "d"}
    assert set(db.count("hello", "env").filter("!a:b").collect()) == {"x"}


def test_overwrite_empty_group_and_missing_tag(spark):
    db = database(spark, [({"a": "b"}, 1, 5.0), ({"a": "b"}, 1, 7.0), ({"a": "old"}, 0, 1.0), ({"z": "b"}, 1, 9.0)])
    assert db.max("hello", "a").start(1).collect() == {"b": [Bucket(1, 1, 7.0, 1)], "old": []}
    groups = db.max("hello", "a").start(1).build()
    assert len(groups) == 2 and "old" in groups and list(groups["old"]) == [] and list(groups["b"]) == [Bucket(1, 1, 7.0, 1)]
    with pytest.raises(KeyError):
        groups["none"]
    assert db.max("hello", "nothing").collect() == {}
    assert db.max("unknown", "a").collect() == {}


def test_nan_and_null_values(spark):
    nan = float("nan")
    db = database(spark, [({"a": "x"}, 1, nan), ({"a": "x"}, 2, 1.0), ({"a": "y"}, 1, nan), ({"a": "z"}, 1, 3.0), ({"a": "z"}, 1, None)])
    assert db.min("hello", "a").collect()["x"] == [Bucket(1, 2, 1.0, 2)] and db.max("hello", "a").collect()["x"][0].value == 1.0
    assert math.isnan(db.sum("hello", "a").collect()["x"][0].value) and math.isnan(db.max("hello", "a").collect()["y"][0].value)
    assert db.count("hello", "a").collect()["z"] == []


def test_bad_queries(spark):
    db = database(spark, SOLO)
    for bad in (lambda: db.avg("Bad", "a"), lambda: db.avg("hello", "a").filter("x y").collect(), lambda: db.avg("hello", "service").granularity(-1).collect()):
        with pytest.raises(InvalidQuery):
            bad()
    assert Bucket(10, 15, 0.0, 1).middle() == 12


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Database.builder(spark).hyper_mode(True).open(path)
    assert db.count("cpu.total", "host").collect() == {}
    for host, value in (("h-1", 25.42), ("h-2", 42.42)):
        db.write("cpu.total", value, {"env": "prod", "service": "db", "host": host})
    assert db.count("cpu.total", "host").collect() == {}
    db.flush(sync=True)
    query = db.avg("cpu.total", "host").filter("env:prod AND service:db").start_relative(days(28)).granularity(days(1))
    assert {g: [(b.value, b.len) for b in bs] for g, bs in query.collect().items()} == {"h-1": [(25.42, 1)], "h-2": [(42.42, 1)]}
    db.write_at("cpu.total", 5, 1.0, {"host": "h-1"})
    db.write_at("cpu.total", 5, 2.0, {"host": "h-1"})
    db.flush()
    again = Database.open(spark, path)
    assert again.max("cpu.total", "host").end(10).collect()["h-1"] == [Bucket(5, 5, 2.0, 1)]
    assert again.series_ids().count() == 3
    series = again.series().where("series_key = 'cpu.total#host:h-1'").first()
    assert again.tags_of(series["series_id"]) == {"host": "h-1"} and again.tags_of(-1) == {}
    smaller = again.compact(str(tmp_path / "compact"))
    assert smaller.points().count() == 3 and smaller.max("cpu.total", "host").collect()["h-1"][-1].value == 2.0
    assert again.max("cpu.total", "host").end_relative(days(1)).collect()["h-2"] == []


def test_scan_of_a_store_is_pruned(spark, tmp_path):
    """A query reads the folders of its metric and months only, and few series go to the scan."""
    db = Database.builder(spark).cache_size_mib(0).open(str(tmp_path / "db"))
    rows = [(m, day * days(1), float(day), {"host": h}) for m in ("cpu", "mem") for h in ("a", "b") for day in range(0, 100, 9)]
    db.write_df(spark.createDataFrame(rows, "metric STRING, ts_ns BIGINT, value DOUBLE, tags MAP<STRING,STRING>"))
    query = db.count("cpu", "host").start(days(30)).filter("!host:b")
    plan = query.matching_points()._jdf.queryExecution().executedPlan().toString()
    assert "metric#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "time_bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "series_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert query.granularity(days(400)).collect() == {"a": [Bucket(days(36), days(99), 8.0, 8)]}


def test_cache_holds_what_fits(spark, tmp_path):
    schema = "metric STRING, ts_ns BIGINT, value DOUBLE, tags MAP<STRING,STRING>"
    db = Database.builder(spark).cache_size_mib(64).open(str(tmp_path / "db"))
    db.write_df(spark.createDataFrame([("m", 1, 1.0, {"a": "b"})], schema))
    assert db.sum("m", "a").collect()["b"][0].value == 1.0 and set(db._cached) == {"points", "series"} and db.points().is_cached
    db.write_df(spark.createDataFrame([("m", 2, 2.0, {"a": "b"})], schema))
    assert not db._cached and db.sum("m", "a").collect()["b"][0].value == 3.0
    db.release()
    assert not Database(spark, db.path, None, None, cache_mib=0).points().is_cached


def test_bulk_writes_are_checked(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"))
    schema = "metric STRING, ts_ns BIGINT, value DOUBLE, tags MAP<STRING,STRING>"
    for bad in (("Bad", 1, 1.0, {}), (None, 1, 1.0, {}), ("m", -1, 1.0, {}), ("m", 1, None, {}), ("m", 1, 1.0, {"a": "b;c"}), ("m", 1, 1.0, {"a:": "b"})):
        with pytest.raises(InvalidQuery):
            db.write_df(spark.createDataFrame([bad, ("m", 1, 1.0, {"a": "b"})], schema))
    assert db.points().count() == 0
    db.write_df(spark.createDataFrame([("m", 1, 1.0, None), ("m", 1, 2.0, {"a": "b"})], schema))
    db.write_df(spark.createDataFrame([], schema))
    assert db.points().count() == 2 and db.sum("m", "a").collect() == {"b": [Bucket(1, 1, 2.0, 1)]}
    with pytest.raises(InvalidQuery):
        db.write_at("m", 1, None, {})
    with pytest.raises(StorageError):
        Database.from_dataframes(db.points(), db.series()).write("m", 1.0, {})


def test_postings(spark):
    services = ["prod-db", "staging-db", "test-db", "prod-ui", "staging-ui", "test-ui"]
    series = spark.createDataFrame([(i, "m", f"k{i}", {"service": s}) for i, s in enumerate(services)] + [(9, "m", "k9", None)], "series_id BIGINT, metric STRING, series_key STRING, tags MAP<STRING,STRING>")
    index = postings.tag_index(series)
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(postings.query_prefix(index, "m", "service", "prod-")) == [0, 3]
    assert ids(postings.query_eq(index, "m", "service", "test-ui")) == [5] and ids(postings.query_eq(index, "m", "service", "no")) == []
    lists = [spark.createDataFrame([(i,) for i in x], "series_id BIGINT") for x in ([1, 2, 3, 4, 5], [1, 3, 5], [1, 3])]
    assert ids(postings.intersection(*lists)) == [1, 3] and ids(postings.complement(*lists[:2])) == [2, 4]
    lists = [spark.createDataFrame([(i,) for i in x], "series_id BIGINT") for x in ([1, 8], [1, 2], [1, 2, 4], [2, 4, 8])]
    assert ids(postings.union(*lists)) == [1, 2, 4, 8]
    blocks = postings.posting_lists(postings.tag_index(series.withColumn("tags", F.create_map(F.lit("all"), F.lit("x")))), block_ids=2).collect()
    assert {r["term"] for r in blocks} == {"m#all:x"} and len(blocks) > 1 and sorted(i for r in blocks for i in r["series_ids"]) == [0, 1, 2, 3, 4, 5, 9]
    row = spark.range(1).select(F.array(F.lit(1), F.lit(8)).alias("a"), F.array(F.lit(2), F.lit(1)).alias("b"))
    assert row.select(postings.union_arrays(F.col("a"), F.col("b")), postings.intersect_arrays(F.col("a"), F.col("b"))).first()[:] == ([1, 2, 8], [1])


def test_stream_ingest(spark, tmp_path):
    from chronoloom.streaming.ingest import ingest_stream, windowed_totals

    source = str(tmp_path / "in")
    schema = "metric STRING, ts_ns BIGINT, value DOUBLE, tags MAP<STRING,STRING>"
    spark.createDataFrame([("m", 1, 1.0, {"a": "b"}), ("m", 2, 2.0, {"a": "b"})], schema).write.parquet(source)
    db = Database.open(spark, str(tmp_path / "db"))
    stream = spark.readStream.schema(schema).parquet(source)
    ingest_stream(stream, db, str(tmp_path / "state"), availableNow=True).awaitTermination(120)
    assert db.sum("m", "a").collect() == {"b": [Bucket(1, 2, 3.0, 2)]}
    query = windowed_totals(stream, "1 minute", "1 minute").writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("totals").first()["total"] == 3.0


def test_now_is_frozen_when_asked(spark):
    query = database(spark, SOLO).count("hello", "service").start_relative(10)
    assert abs(timestamp() - query.start_ns) < 10**12
