"""Continuous ingest: a stream of tagged points is appended to a database batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoloom.sources.store import Database


def ingest_stream(stream: DataFrame, db: Database, checkpoint: str, **trigger) -> StreamingQuery:
    """Write ``metric, ts_ns, value, tags`` rows of ``stream`` into ``db``.

    Late points are simply inserted at their time. A batch that is written again after a failure adds equal
    points, of which reads see one.
    """

    def write(batch: DataFrame, number: int) -> None:
        db.write_df(batch)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start() if trigger else writer.start()


def windowed_totals(stream: DataFrame, width: str, lateness: str) -> DataFrame:
    """An extension: totals per metric and epoch-aligned window of a stream, closed after ``lateness``.

    These windows lie on the clock's grid; they are not the buckets anchored on the newest point.
    """
    timed = stream.withColumn("at", F.timestamp_micros(F.expr("ts_ns div 1000")))
    grouped = timed.withWatermark("at", lateness).groupBy(F.window("at", width), "metric")
    totals = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return totals.select("metric", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")
