"""The inverted index of tags as a table, and set operations on lists of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.functions.names import term_column
from chronoloom.operators.staging import dimension, join_dimension


def tag_index(series: DataFrame) -> DataFrame:
    """``metric, key, value, series_id``: one row per tag of a series. Null maps and values give none."""
    return series.select("metric", F.explode("tags").alias("key", "value"), "series_id").where("value IS NOT NULL").distinct()


#: Ids of one block of a posting list, about.
BLOCK_IDS = 10_000


def posting_lists(index: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``term, block, series_ids``: the ids of each term, in blocks of about ``block_ids`` sorted ids.

    A term may be on a third of all series, so its list is cut by a hash of the id; the blocks of a term are
    disjoint and together its list. Lists hold ids of series, not of points.
    """
    named = index.select(term_column(F.col("metric"), F.col("key"), F.col("value")).alias("term"), "series_id")
    sizes = dimension(named.groupBy("term").agg(F.ceil(F.count("*") / F.lit(block_ids)).alias("blocks")))
    cut = join_dimension(named, sizes, "term", F.col("series_id")).withColumn("block", F.expr("pmod(xxhash64(series_id), blocks)"))
    return cut.groupBy("term", "block").agg(F.array_sort(F.collect_set("series_id")).alias("series_ids"))


def query_eq(index: DataFrame, metric: str, key: str, value: str) -> DataFrame:
    """Ids of the series of ``metric`` with the tag."""
    return index.where((F.col("metric") == metric) & (F.col("key") == key) & (F.col("value") == value)).select("series_id").distinct()


def query_prefix(index: DataFrame, metric: str, key: str, prefix: str) -> DataFrame:
    """Ids of the series of ``metric`` whose tag begins with ``prefix``."""
    return index.where((F.col("metric") == metric) & (F.col("key") == key) & F.startswith(F.col("value"), F.lit(prefix))).select("series_id").distinct()


def intersection(*lists: DataFrame) -> DataFrame:
    """Ids that are in all lists."""
    return reduce(DataFrame.intersect, lists)


def union(*lists: DataFrame) -> DataFrame:
    """Ids that are in any list, each once."""
    return reduce(DataFrame.union, lists).distinct()


def complement(everything: DataFrame, *lists: DataFrame) -> DataFrame:
    """Ids of ``everything`` that are in none of the lists."""
    return reduce(DataFrame.subtract, lists, everything.distinct())


def intersect_arrays(*arrays: Column) -> Column:
    """Posting lists as array columns: ids in all of them, in the order of the first."""
    return reduce(F.array_intersect, arrays)


def union_arrays(*arrays: Column) -> Column:
    """Posting lists as array columns: ids in any of them, sorted, each once."""
    return F.array_sort(reduce(F.array_union, arrays))
