"""A stored database of tagged points: two Parquet tables in one folder, or DataFrames one already has.

    <path>/<prefix>points   series_id, ts_ns, value, ingest_seq; partitioned by metric and month
    <path>/<prefix>series   series_id, metric, series_key, tags

Writing appends; the last write of a series and time wins when reading. ``compact`` rewrites the points with
the overwritten ones left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from chronoloom.errors import InvalidQuery, StorageError
from chronoloom.functions.duration import timestamp
from chronoloom.functions.names import MetricName, check_tags, is_metric_name, series_key_column
from chronoloom.operators.staging import dimension, join_dimension, known_rows, with_known_rows
from chronoloom.plans.query import Options, Query

POINTS = "series_id BIGINT, ts_ns BIGINT, value DOUBLE, ingest_seq BIGINT, metric STRING, time_bucket STRING"
SERIES = "series_id BIGINT, metric STRING, series_key STRING, tags MAP<STRING,STRING>"
POINTS_IN = "metric STRING, ts_ns BIGINT, value DOUBLE, tags MAP<STRING,STRING>, ingest_seq BIGINT"

#: Points of a file, about.
FILE_POINTS = 4_000_000
#: Points a database in hyper mode holds on the driver before it writes them on its own.
BUFFERED_POINTS = 1_000_000


class Database:
    """Handle of a database; cheap to copy, safe to share between queries."""

    def __init__(
        self,
        spark: SparkSession,
        path: str | None,
        points: DataFrame | None,
        series: DataFrame | None,
        *,
        hyper: bool = False,
        cache_mib: int = 0,
        prefix: str = "",
        options: Options = Options(),
    ):
        self.spark, self.path, self.hyper, self.cache_mib, self.prefix, self.options = spark, path, hyper, cache_mib, prefix, options
        self._points, self._series = points, series
        self._buffer: list[tuple] = []
        self._count = itertools.count()
        self._cached: dict[str, DataFrame] = {}

    # -- opening

    @staticmethod
    def builder(spark: SparkSession) -> DatabaseBuilder:
        return DatabaseBuilder(spark)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **settings) -> Database:
        """Open the database at ``path``, or create an empty one there."""
        db = cls(spark, path.rstrip("/"), None, None, **settings)
        for name, schema in (("points", POINTS), ("series", SERIES)):
            if not db._exists(name):
                db._append(spark.createDataFrame([], schema), name)
        return db

    @classmethod
    def from_dataframes(cls, points: DataFrame, series: DataFrame, **settings) -> Database:
        """A read-only database over tables of the stored shape (``ingest_seq`` may be missing)."""
        if "ingest_seq" not in points.columns:
            points = points.withColumn("ingest_seq", F.lit(0).cast("long"))
        return cls(points.sparkSession, None, points, series, **settings)

    def _at(self, name: str) -> str:
        return f"{self.path}/{self.prefix}{name}"

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _append(self, df: DataFrame, name: str, mode: str = "append", to: str | None = None) -> None:
        self.release()
        writer = df.write.mode(mode).option("compression", "zstd")
        (writer.partitionBy("metric", "time_bucket") if name == "points" else writer).parquet(to or self._at(name))

    def points(self) -> DataFrame:
        return self._table("points", POINTS, self._points)

    def series(self) -> DataFrame:
        return self._table("series", SERIES, self._series)

    def _table(self, name: str, schema: str, given: DataFrame | None) -> DataFrame:
        if name in self._cached:
            return self._cached[name]
        df = given if given is not None else self.spark.read.schema(schema).parquet(self._at(name))
        if self.cache_mib and self._mib_of(df) + sum(map(self._mib_of, self._cached.values())) <= self.cache_mib:
            self._cached[name] = df.persist()
        return df

    @staticmethod
    def _mib_of(df: DataFrame) -> float:
        """Size of a table as the optimizer knows it, without a job; of files that is their size."""
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / (1 << 20)

    def release(self) -> None:
        """Give the cache back; writing does so too, because the tables have changed."""
        while self._cached:
            self._cached.popitem()[1].unpersist()

    # -- writing

    def write(self, metric: str, value: float, tags: Mapping[str, str]) -> None:
        """Add a point at the present time."""
        self.write_at(metric, timestamp(), value, tags)

    def write_at(self, metric: str, ts_ns: int, value: float, tags: Mapping[str, str]) -> None:
        """Add a point, or overwrite the one at the same series and time.

        Points are buffered on the driver: until ``flush`` in hyper mode, else until the end of the call.
        For more than a few points :meth:`write_df` is the way.
        """
        if self.path is None:
            raise StorageError("a database over DataFrames is read-only")
        if value is None or not 0 <= ts_ns < 1 << 63:
            raise InvalidQuery(f"invalid point: value {value!r} at {ts_ns!r}")
        self._buffer.append((MetricName(metric), ts_ns, float(value), check_tags(tags), timestamp() + next(self._count)))
        if not self.hyper or len(self._buffer) >= BUFFERED_POINTS:
            self.flush()

    def flush(self, sync: bool = False) -> None:
        """Write what is buffered. Committed files are durable as the file system is; ``sync`` changes nothing."""
        if self._buffer:
            rows, self._buffer = self._buffer, []
            self.write_df(self.spark.createDataFrame(rows, POINTS_IN))

    def write_df(self, df: DataFrame) -> None:
        """Add points in bulk: ``metric, ts_ns, value, tags`` and, if given, ``ingest_seq``.

        Rows without it all get the present time; of rows equal in series, time and ``ingest_seq`` the
        greatest value is kept. The batch is checked as a whole before anything is written.

        ``df`` is read twice, and its points are shuffled and written once. The first pass is one map-side combined
        count by metric, tags and month: it checks the points, finds the series and sizes the files. The text of a
        series' key is made once per distinct set of tags, not per point.
        """
        if self.path is None:
            raise StorageError("a database over DataFrames is read-only")
        seq = F.col("ingest_seq") if "ingest_seq" in df.columns else F.lit(timestamp())
        given = df.select(
            "metric", "ts_ns", "value", seq.cast("long").alias("ingest_seq"),
            F.coalesce(F.map_keys("tags"), F.array().cast("array<string>")).alias("tag_keys"), F.coalesce(F.map_values("tags"), F.array().cast("array<string>")).alias("tag_values"),
        )
        at = F.col("ts_ns") >= 0
        good = F.coalesce(at & F.col("value").isNotNull(), F.lit(False))
        month = F.when(at, month_number()).alias("month")
        counted = dimension(given.groupBy("metric", "tag_keys", "tag_values", month).agg(F.count("*").alias("n"), F.min(good).alias("good")))
        odd_key = F.exists("tag_keys", lambda k: (k == "") | k.rlike("[;:]"))
        odd_value = F.exists("tag_values", lambda v: v.isNull() | v.contains(";"))
        refused = counted.where(~F.coalesce(F.col("good") & is_metric_name(F.col("metric")) & ~odd_key & ~odd_value, F.lit(False))).limit(1).collect()
        if refused:
            raise InvalidQuery(f"refused a point among {refused[0].asDict()}")
        tags = F.map_from_arrays("tag_keys", "tag_values")
        keyed = counted.select("metric", "tag_keys", "tag_values").distinct().withColumn("series_key", series_key_column(F.col("metric"), tags))
        series = dimension(keyed.withColumn("series_id", F.xxhash64("series_key")))
        self._register(series)
        ids = with_known_rows(series.select("metric", "tag_keys", "tag_values", "series_id"), known_rows(series))
        points = join_dimension(given, ids, ["metric", "tag_keys", "tag_values"], F.col("ts_ns"))
        points = points.select("series_id", "ts_ns", "value", "ingest_seq", "metric", month_number().alias("month"))
        self._append(_laid_out(points, counted.groupBy("metric", "month").agg(F.sum("n").alias("n"))), "points")

    def _register(self, series: DataFrame) -> None:
        """Add the series that are not known yet; ids are hashes, so two keys of one id are refused.

        Tags in another order are the same series.
        """
        known = self.spark.read.schema(SERIES).parquet(self._at("series")).select("series_key", "series_id")
        fresh = dimension(series.dropDuplicates(["series_key"]).join(known.select("series_key"), "series_key", "left_anti"))
        if not fresh.limit(1).count():
            return
        both = known.unionByName(fresh.select("series_key", "series_id")).join(fresh.select("series_id"), "series_id", "left_semi")
        if both.groupBy("series_id").agg(F.countDistinct("series_key").alias("keys")).where("keys > 1").limit(1).count():
            raise StorageError("two series have the same id")
        tags = F.map_from_arrays("tag_keys", "tag_values")
        self._append(fresh.select("series_id", "metric", "series_key", tags.alias("tags")), "series")

    def compact(self, to: str) -> Database:
        """A database at ``to`` with one row per series and time, sorted within its files."""
        self._append(self.series(), "series", "errorifexists", f"{to}/{self.prefix}series")
        newest = F.max(F.struct("ingest_seq", "value"))
        rows = self.points().groupBy("metric", "series_id", "ts_ns").agg(newest.alias("x"))
        points = rows.select("series_id", "ts_ns", "x.value", "x.ingest_seq", "metric", month_number().alias("month"))
        counts = points.groupBy("metric", "month").agg(F.count("*").alias("n"))
        self._append(_laid_out(points, counts), "points", "errorifexists", f"{to}/{self.prefix}points")
        return Database.open(self.spark, to, hyper=self.hyper, cache_mib=self.cache_mib, prefix=self.prefix, options=self.options)

    def tags_of(self, series_id: int) -> dict[str, str]:
        """Tags of a series; none for a series that is not known or has none."""
        row: Row | None = self.series().where(F.col("series_id") == series_id).select("tags").first()
        return dict(row["tags"] or {}) if row else {}

    def series_ids(self) -> DataFrame:
        """Ids of the series of all metrics."""
        return self.series().select("series_id").distinct()

    # -- querying

    def _query(self, agg: str, metric: str, group_by: str) -> Query:
        return Query(self.points(), self.series(), MetricName(metric), agg, group_by, options=self.options, exact_months=self.path is not None)

    def avg(self, metric: str, group_by: str) -> Query:
        return self._query("avg", metric, group_by)

    def sum(self, metric: str, group_by: str) -> Query:
        return self._query("sum", metric, group_by)

    def min(self, metric: str, group_by: str) -> Query:
        return self._query("min", metric, group_by)

    def max(self, metric: str, group_by: str) -> Query:
        return self._query("max", metric, group_by)

    def count(self, metric: str, group_by: str) -> Query:
        return self._query("count", metric, group_by)


def _laid_out(points: DataFrame, counts: DataFrame) -> DataFrame:
    """Points as their files shall hold them: a folder per metric and month, newest first within a series.

    ``counts`` has the rows ``n`` of each folder; a folder gets one file for about every ``FILE_POINTS`` of them, cut
    by series and day, so neither many small files come about nor a task that writes a whole large month.
    """
    name = F.concat(F.floor(F.col("month") / 12).cast("int"), F.lit("-"), F.lpad(F.col("month") % 12 + 1, 2, "0"))
    sizes = counts.select("metric", "month", F.ceil(F.col("n") / F.lit(FILE_POINTS)).alias("files"), name.alias("time_bucket"))
    cut = join_dimension(points, dimension(sizes), ["metric", "month"], F.col("ts_ns"))
    cut = cut.withColumn("file", F.expr("pmod(xxhash64(series_id, ts_ns div 86400000000000), files)"))
    spread = cut.repartition("metric", "time_bucket", "file").drop("files", "file", "month")
    return spread.sortWithinPartitions("metric", "time_bucket", "series_id", F.desc("ts_ns"))


def month_number() -> Column:
    """Months from the year 0 to ``ts_ns``, in UTC whatever the session's time zone: whole numbers all the way."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(ts_ns div 86400000000000 AS INT)"))
    return F.year(day) * 12 + F.month(day) - 1


class DatabaseBuilder:
    """Settings of a database before it is opened."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.settings: dict = {}

    def _with(self, **settings) -> DatabaseBuilder:
        built = DatabaseBuilder(self.spark)
        built.settings = self.settings | settings
        return built

    def cache_size_mib(self, mib: int) -> DatabaseBuilder:
        """Cache tables in the executors' storage memory while their files have at most ``mib`` together; 0 turns it off."""
        return self._with(cache_mib=max(0, mib))

    def hyper_mode(self, enabled: bool) -> DatabaseBuilder:
        """Keep written points on the driver until ``flush``; what was not flushed is lost with the driver."""
        return self._with(hyper=enabled)

    def prefix(self, prefix: str) -> DatabaseBuilder:
        """Prefix of the tables' names, to share a folder with other data."""
        return self._with(prefix=prefix)

    def options(self, **options) -> DatabaseBuilder:
        return self._with(options=Options(**options))

    def open(self, path: str) -> Database:
        return Database.open(self.spark, path, **self.settings)

    def open_over(self, points: DataFrame, series: DataFrame) -> Database:
        """Open over tables that exist already."""
        return Database.from_dataframes(points, series, **self.settings)
