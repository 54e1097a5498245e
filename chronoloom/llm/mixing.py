"""Mix sources to target shares of a total size in tokens.

Every record draws an Efraimidis-Spirakis key from its identity and a seed: with u uniform in (0, 1) and a
quality weight w the key is ``-ln(u) / w``, and taking the smallest keys is weighted sampling without
replacement. A source whose target needs more than its whole size first gives complete epochs (every record
once per epoch); the rest of its target is the longest prefix of its records in key order that fits the
remaining token budget, by prefix sums of tokens.

The prefix sums are hierarchical: keys fall into ``FANOUT`` bins per source, the tokens of the bins are
summed with map-side combining, and only the bin in which the budget ends is opened, again into bins, until
it is small enough to be ordered record by record. No task ever orders a whole source.

Sources are compared without case and outer white space; a null source is the source ''. Records whose
source has no target are not used. A source that cannot fill its share even at ``max_repeats`` is used
``max_repeats`` times and marked short. Null and empty texts have no tokens and cost nothing. Records with
equal keys (repeated rows) are ordered by token count; if they are cut apart it does not matter which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronoloom.llm.tokens import TOKENIZER, with_token_counts
from chronoloom.operators.staging import dimension, join_dimension

#: Bins of one level of the prefix sums.
FANOUT = 1024
#: Records of an opened bin that are ordered by a window.
ORDERED_ROWS = 100_000
#: Levels of bins; beyond this, keys are equal to the precision of doubles.
LEVELS = 5


def plain_source(column: str) -> Column:
    """The source without case and outer white space; null becomes ''."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^[\s ]+|[\s ]+$", ""))


def quality_weight(score: Column) -> Column:
    """A weight in [0.05, 1] from a score; an unknown score counts as 0.5."""
    known = F.when(score.isNotNull() & ~F.isnan(score), score).otherwise(F.lit(0.5))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.05), known))


def keyed_records(documents: DataFrame, *, seed: int = 0, weight: Column | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source_key, tokens, place``: ``place`` in [0, 1) orders records as their keys do.

    A key k is at most 37 / 0.05, so its place ``k / (1 + k)`` stays below 1 and keys far from zero stay apart.
    """
    w = F.lit(1.0) if weight is None else weight
    picked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), plain_source("source").alias("source_key"), "text", w.cast("double").alias("weight"))
    counted = with_token_counts(picked, "text", "tokens", tokenizer)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    key = -F.log(uniform) / F.col("weight")
    return counted.select("doc_id", "source_key", "tokens", (key / (key + 1)).alias("place"))


def source_plan(records: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: sizes, budget, epochs and the budget of the fractional selection.

    Columns: ``source, source_key, target_share, max_repeats, size, records, all_size, budget, epochs,
    rest, short``. The total is ``total_tokens`` or the size of all records, each counted once.
    A target with a null share counts as 0, with null repeats as 1; targets of equal sources are added up.
    """
    sizes = dimension(records.groupBy("source_key").agg(F.sum("tokens").alias("size"), F.count("*").alias("records")))
    total = total_tokens if total_tokens is not None else (sizes.agg(F.sum("size")).first()[0] or 0)
    wanted = targets.withColumn("source_key", plain_source("source")).groupBy("source_key").agg(
        F.min("source").alias("source"), F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).cast("long").alias("max_repeats"),
    )
    met = wanted.join(sizes, "source_key", "left").fillna(0, ["size", "records"]).withColumn("all_size", F.lit(total).cast("long"))
    budget = F.floor(F.col("target_share") * F.col("all_size"))
    full = F.when(F.col("size") > 0, F.floor(budget / F.col("size"))).otherwise(F.lit(0))
    short = F.col("size") * F.col("max_repeats") < F.col("target_share") * F.col("all_size")
    planned = met.withColumns({"budget": budget.cast("long"), "epochs": F.least(full, F.col("max_repeats")).cast("long"), "short": short})
    return dimension(planned.withColumn("rest", F.when(F.col("short") | (F.col("epochs") >= F.col("max_repeats")), F.lit(0)).otherwise(F.col("budget") - F.col("epochs") * F.col("size")).cast("long")))


def mixture(records: DataFrame, plan: DataFrame) -> DataFrame:
    """``doc_id, source, tokens, copies`` of the records in the mixture (``copies`` at least 1).

    ``records`` must be a stored table of :func:`keyed_records`, ``plan`` one of :func:`source_plan`.
    """
    planned = plan.select("source_key", "source", "epochs", "rest")
    used = join_dimension(records, planned, "source_key", F.col("doc_id"))
    chosen = join_dimension(used, _limits(records, plan), "source_key", F.col("doc_id"), "left")
    first = F.col("place") < F.coalesce("below", F.lit(0.0))
    inside = (F.col("place") >= F.col("below")) & (F.col("place") < F.col("until"))
    ordered = W.partitionBy("source_key").orderBy("place", "tokens", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    opened = chosen.where(inside).withColumn("upto", F.col("spent") + F.sum("tokens").over(ordered)).withColumn("extra", (F.col("upto") <= F.col("rest")).cast("long"))
    plain = chosen.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", first.cast("long"))
    columns = ["doc_id", "source", "tokens", (F.col("epochs") + F.col("extra")).alias("copies")]
    return plain.select(*columns).unionByName(opened.select(*columns)).where("copies > 0")


def _limits(records: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source with a fractional selection: everything placed below ``below`` is in (``spent`` tokens); the
    budget ends between ``below`` and ``until``. At most one row per target source."""
    limits = dimension(
        plan.where("rest > 0").select("source_key", "rest", F.lit(0.0).alias("below"), F.lit(1.0).alias("until"), F.lit(0).cast("long").alias("spent"), F.col("records").alias("rows"))
    )
    for _ in range(LEVELS):
        if not limits.where(F.col("rows") > ORDERED_ROWS).limit(1).count():
            break
        at = join_dimension(records.select("source_key", "tokens", "place"), limits, "source_key", F.col("tokens")).where("place >= below AND place < until")
        bin_ = F.least(F.floor((F.col("place") - F.col("below")) / (F.col("until") - F.col("below")) * FANOUT), F.lit(FANOUT - 1)).cast("int")
        summed = at.groupBy("source_key", bin_.alias("bin")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        upto = F.sum("tokens").over(W.partitionBy("source_key").orderBy("bin"))
        bins = summed.withColumn("upto", upto).join(limits, "source_key")
        # the first bin in which the budget is exceeded
        ends = bins.where(F.col("spent") + F.col("upto") > F.col("rest")).groupBy("source_key").agg(
            F.min_by(F.struct("bin", "n", (F.col("upto") - F.col("tokens")).alias("before")), "bin").alias("end")
        )
        width = (F.col("until") - F.col("below")) / FANOUT
        fits = F.col("end").isNull()  # all of the range fits
        limits = dimension(
            limits.join(ends, "source_key", "left").select(
                "source_key", "rest",
                F.when(fits, F.col("until")).otherwise(F.col("below") + width * F.col("end.bin")).alias("below"),
                F.when(fits | (F.col("end.bin") == FANOUT - 1), F.col("until")).otherwise(F.col("below") + width * (F.col("end.bin") + 1)).alias("until"),
                (F.col("spent") + F.coalesce("end.before", F.lit(0))).alias("spent"), F.coalesce("end.n", F.lit(0)).alias("rows"),
            )
        )
    return limits.drop("rest", "rows")


def actual_shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target: ``source, target_share, actual_share, tokens, records, copies, epochs, short``.

    The actual share is of the mixture's own size, 0 for an empty mixture. ``short`` is judged by the mixture as made:
    every record of the source is in it ``max_repeats`` times, and still its tokens are less than the target share.
    """
    got = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("used"), F.sum("copies").alias("copies")
    )
    planned = plan.select("source", "target_share", "max_repeats", "size", "records", "all_size", "epochs")
    met = planned.join(got, "source", "left").fillna(0, ["tokens", "used", "copies"])
    whole = F.sum("tokens").over(W.partitionBy())
    share = F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0))
    spent = (F.col("tokens") == F.col("size") * F.col("max_repeats")) & ((F.col("copies") == F.col("records") * F.col("max_repeats")))
    short = spent & (F.col("tokens") < F.col("target_share") * F.col("all_size"))
    return met.select("source", "target_share", share.alias("actual_share"), "tokens", F.col("used").alias("records"), "copies", "epochs", short.alias("short"))
