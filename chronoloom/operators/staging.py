"""Intermediate tables and joins whose small side is measured before it is broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronoloom.errors import StorageError

#: Rows up to which a dimension is broadcast. At some 100 bytes a row this is about 50 MB.
BROADCAST_ROWS = 500_000
#: A table of at most this many rows, made from at most this many bytes, is kept on the driver instead of being written.
LOCAL_ROWS, LOCAL_INPUT_BYTES = 20_000, 512 << 20
#: A key is hot in a shuffled join if it holds more than one in so many of the facts, and at least so many rows.
HOT_PARTS, HOT_ROWS = 2000, 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local master, which has a single machine, gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise StorageError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="chronoloom-")
    context.setCheckpointDir(own)
    return context.getCheckpointDir().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder when the driver's Python ends."""
    atexit.register(_remove, spark, path)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage (a lost executor costs nothing that was written) and gives the
    optimizer true sizes. The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/chronoloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`staged` that nothing reads any more."""
    for name in df.inputFiles():
        _remove(df.sparkSession, name)


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than that."""
    return df.limit(most + 1).count() <= most


def dimension(df: DataFrame) -> DataFrame:
    """``df`` computed once, to be joined by its measured size.

    A small table made from little input becomes a local one in a single job. Anything else is staged: where
    the input is large it must not be computed a second time to find that the result is large too.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size <= LOCAL_INPUT_BYTES:
        found = df.limit(LOCAL_ROWS + 1).toArrow()
        if found.num_rows <= LOCAL_ROWS:
            return with_known_rows(df.sparkSession.createDataFrame(found, df.schema), found.num_rows)
    written = staged(df)
    return with_known_rows(written, written.count())


#: The same under a name that arguments do not hide.
computed = dimension


def with_known_rows(df: DataFrame, rows: int | None) -> DataFrame:
    """Note how many rows ``df`` has, so that joins need not count them."""
    df.known_rows = rows
    return df


def known_rows(df: DataFrame) -> int | None:
    """The noted number of rows; None if it was never counted."""
    return getattr(df, "known_rows", None) if "known_rows" not in df.columns else None


def join_dimension(
    facts: DataFrame, dimension: DataFrame, on: str | list[str], salt: Column, how: str = "inner", most: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a measured dimension to facts that may hold one key in a third of their rows.

    Up to ``most`` rows the dimension is broadcast and the facts are not shuffled. Beyond that both are shuffled by key.
    Keys that hold more than one in ``HOT_PARTS`` of all facts, of which there are fewer than ``HOT_PARTS``, are counted
    first. Only these are cut into slices of about that size, by ``salt`` (any integer column that varies within a key),
    and only their rows of the dimension are repeated, once per slice; so no task gets a whole hot key.
    """
    on = [on] if isinstance(on, str) else list(on)
    known = known_rows(dimension)
    if known <= most if isinstance(known, int) else is_small(dimension, most):
        return facts.join(F.broadcast(dimension), on, how)
    hot = hot_keys(facts, on)
    if not hot.limit(1).count():
        return facts.join(dimension.hint("merge"), on, how)
    left = facts.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(salt), F.col("_slices")), F.lit(0)).cast("int")).drop("_slices")
    slices = F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)).cast("int") - 1)
    right = dimension.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(slices)).drop("_slices")
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def hot_keys(facts: DataFrame, on: list[str]) -> DataFrame:
    """The columns ``on`` and ``_slices`` of the keys that hold more than one in ``HOT_PARTS`` of all facts.

    One pass that reads the key columns only, combined on the map side. Fewer than ``HOT_PARTS`` keys can be hot.
    """
    counts = staged(facts.groupBy(*on).agg(F.count("*").alias("_n")))
    rows = counts.agg(F.sum("_n")).first()[0] or 0
    part = max(rows / HOT_PARTS, HOT_ROWS)
    return computed(counts.where(F.col("_n") > part).select(*on, F.ceil(F.col("_n") / F.lit(part)).alias("_slices")))
