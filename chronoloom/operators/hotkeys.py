"""Per-key results when a few keys hold most rows.

Every aggregate here is algebraic, so Spark combines it in bounded hash tables on the map side (spilling
when they fill) and shuffles one compact state per key and task; a key with a third of all rows costs the
reducer no more than any other key. Tag keys are not counted over rows again: the states of the series
are re-combined through the series dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def series_states(points: DataFrame) -> DataFrame:
    """Mergeable state of each series over all rows, repeats included.

    Columns: ``series_id, n_rows, n_values, total, least, most, first_ns, last_ns``. Null and NaN values
    count in ``n_rows`` only. Rows without ``series_id`` form the state of the null series.
    """
    good = F.when(~F.isnan("value"), F.col("value"))
    return points.groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.count(good).alias("n_values"), F.sum(good).alias("total"),
        F.min(good).alias("least"), F.max(good).alias("most"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
    )


def merge_states(states: DataFrame, *keys: str) -> DataFrame:
    """Combine states of :func:`series_states` that share ``keys``; associative and commutative."""
    return states.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"),
    )


def states_by_key(points: DataFrame, series: DataFrame, tag_keys: DataFrame) -> DataFrame:
    """States of every series (``key_name`` 'series_id', the value as text) and of every wanted tag value.

    Both forms come from one pass over the points: the series states are exploded into their keys.
    """
    wanted = tag_keys.select("key_name").where("key_name IS NOT NULL").distinct()
    tags = (
        series.where("series_id IS NOT NULL").dropDuplicates(["series_id"])
        .select("series_id", F.explode("tags").alias("key_name", "key_value"))
        .where("key_value IS NOT NULL")
        .join(wanted, "key_name", "left_semi")
        .groupBy("series_id").agg(F.collect_list(F.struct("key_name", "key_value")).alias("pairs"))
    )
    own = F.struct(F.lit("series_id").alias("key_name"), F.col("series_id").cast("string").alias("key_value"))
    pairs = F.concat(F.array(own), F.coalesce("pairs", F.array().cast("array<struct<key_name:string,key_value:string>>")))
    spread = (
        series_states(points).where("series_id IS NOT NULL").join(tags, "series_id", "left").withColumn("pair", F.explode(pairs)).select("*", "pair.*")
    )
    return merge_states(spread, "key_name", "key_value")


def heavy_keys(points: DataFrame, series: DataFrame, tag_keys: DataFrame, share: int = 50) -> DataFrame:
    """Keys that hold at least 1/``share`` of all rows, with their states and ``all_rows``.

    All rows count, also those without a series; their number is read from the file footers where the
    source allows it. An empty table has no heavy keys.
    """
    total = points.count()
    return states_by_key(points, series, tag_keys).withColumn("all_rows", F.lit(total).cast("long")).where(F.col("n_rows") * share >= total)
