"""Ordinary tables as tagged points: the shape a store ingests and a query reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.functions.names import MetricName, series_key_column


def nanoseconds(time: Column) -> Column:
    """Nanoseconds since 1970-01-01 of a TIMESTAMP or TIMESTAMP_NTZ, whose clock is taken as UTC."""
    local = time.cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), local) * 1000


def as_points_in(df: DataFrame, metric: str, time: Column, value: Column, tags: Mapping[str, Column], order: Column | None = None) -> DataFrame:
    """``metric, ts_ns, value, tags, ingest_seq``: rows with a null time or value are left out, null tags too."""
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in tags.items()]), lambda e: e["value"].isNotNull())
    rows = df.select(
        F.lit(MetricName(metric)).alias("metric"), nanoseconds(time).alias("ts_ns"), value.cast("double").alias("value"),
        F.map_from_entries(pairs).alias("tags"), (F.lit(0) if order is None else order).cast("long").alias("ingest_seq"),
    )
    return rows.where("ts_ns IS NOT NULL AND value IS NOT NULL")


def split_points(points_in: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, series) of tagged points; the id of a series is a hash of its key, checked where stored."""
    keyed = points_in.withColumn("series_key", series_key_column(F.col("metric"), F.col("tags"))).withColumn("series_id", F.xxhash64("series_key"))
    points = keyed.select("series_id", "ts_ns", "value", "ingest_seq", "metric")
    series = keyed.select("series_id", "metric", "series_key", "tags").dropDuplicates(["series_key"])
    return points, series
