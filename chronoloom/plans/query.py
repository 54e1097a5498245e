"""Aggregate queries: an immutable builder that becomes one lazy DataFrame of buckets."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, functions as F

from chronoloom.errors import InvalidQuery
from chronoloom.functions.duration import minutes, timestamp
from chronoloom.functions.names import MetricName
from chronoloom.operators import buckets
from chronoloom.operators.staging import dimension, join_dimension, known_rows, staged
from chronoloom.plans.filters import parse_filter

#: Series up to which their ids go to the scan.
FEW_SERIES = 500


@dataclass(frozen=True)
class Bucket:
    """Points aggregated: times of the oldest and newest one, their value and their number."""

    start: int
    end: int
    value: float
    len: int

    def middle(self) -> int:
        return self.start + (self.end - self.start) // 2


@dataclass(frozen=True)
class Options:
    """How to read. The defaults follow the documented intent; the others reproduce historical behaviour.

    ``boundary="drop"`` loses the point that closes a bucket; ``order="series"`` reads the series of a group
    one after the other; ``not_scope="db"`` lets a filter with a negation reach the series of all metrics;
    ``sets`` accepts ``key:[a, b]``; ``single_precision`` rounds values to 32 bits.
    """

    boundary: str = "keep"
    order: str = "time"
    not_scope: str = "metric"
    sets: bool = False
    single_precision: bool = False


@dataclass(frozen=True)
class Query:
    """A query over stored points and series. Every method returns a new query; nothing runs until asked."""

    points: DataFrame
    series: DataFrame
    metric: str
    agg: str
    group_by: str
    filter_text: str | None = None
    start_ns: int | None = None
    end_ns: int | None = None
    width_ns: int = minutes(1)
    options: Options = Options()
    exact_months: bool = False

    def filter(self, text: str | None) -> Query:
        return replace(self, filter_text=text)

    def start(self, ts_ns: int) -> Query:
        return replace(self, start_ns=ts_ns)

    def end(self, ts_ns: int) -> Query:
        return replace(self, end_ns=ts_ns)

    def start_relative(self, ago_ns: int) -> Query:
        """From ``ago_ns`` before now on; now is the time of this call."""
        return self.start(max(0, timestamp() - ago_ns))

    def end_relative(self, ago_ns: int) -> Query:
        return self.end(max(0, timestamp() - ago_ns))

    def granularity(self, width_ns: int) -> Query:
        return replace(self, width_ns=width_ns)

    def with_options(self, **changes) -> Query:
        return replace(self, options=replace(self.options, **changes))

    def matching_series(self) -> DataFrame:
        """``series_id, group`` of the series the filter selects that have the group tag."""
        node = parse_filter(self.filter_text, self.options.sets)
        chosen = node.to_column(F.col("tags"))
        if self.within_metric():
            chosen = (F.col("metric") == MetricName(self.metric)) & chosen
        elif self.options.not_scope != "db":
            raise InvalidQuery("not_scope is 'metric' or 'db'")
        group = F.try_element_at("tags", F.lit(self.group_by))
        found = self.series.where(chosen & F.col("series_id").isNotNull()).select("series_id", group.alias("group"))
        return found.where("group IS NOT NULL").dropDuplicates(["series_id"])

    def matching_writes(self, chosen: DataFrame) -> DataFrame:
        """``group, series_id, ts_ns, value, ingest_seq``: the writes to the chosen series within the bounds.

        Bounds go to the scan as they are. In a store of this package (``exact_months``) a point's folders are its
        series' metric and the month of ``ts_ns``, so other metrics and the months outside the bounds are not listed,
        and the ids of a few series go to the scan too, in whose files points are sorted by them.
        """
        rows = self.points
        if self.start_ns is not None:
            rows = rows.where(F.col("ts_ns") >= F.lit(self.start_ns).cast("long"))
        if self.end_ns is not None:
            rows = rows.where(F.col("ts_ns") <= F.lit(self.end_ns).cast("long"))
        if self.exact_months:
            for bound, keep in ((self.start_ns, lambda m: F.col("time_bucket") >= m), (self.end_ns, lambda m: F.col("time_bucket") <= m)):
                if bound is not None:
                    rows = rows.where(keep(month_of(F.lit(bound).cast("long"))))
            if self.within_metric():
                rows = rows.where(F.col("metric") == self.metric)
            if (known_rows(chosen) or 0) <= FEW_SERIES:
                rows = rows.where(F.col("series_id").isin([row["series_id"] for row in chosen.select("series_id").collect()]))
        rows = rows.select("series_id", "ts_ns", "value", "ingest_seq").where("series_id IS NOT NULL AND ts_ns >= 0")
        joined = join_dimension(rows, chosen, "series_id", F.col("ts_ns"))
        value = F.col("value").cast("float").cast("double") if self.options.single_precision else F.col("value").cast("double")
        return joined.select("group", "series_id", "ts_ns", value.alias("value"), "ingest_seq")

    def matching_points(self) -> DataFrame:
        """``group, series_id, ts_ns, value``: the last write of each series and time, within the bounds."""
        return buckets.last_writes(self.matching_writes(dimension(self.matching_series())))

    def within_metric(self) -> bool:
        """Whether only series of the query's metric can match."""
        return self.options.not_scope == "metric" or "!" not in (self.filter_text or "")

    def one_bucket(self) -> bool:
        """Whether the bounds alone show that each group is a single bucket."""
        return self.start_ns is not None and self.end_ns is not None and 0 <= self.end_ns - self.start_ns <= self.width_ns

    def to_df(self) -> DataFrame:
        """``group, start, end, value, len``. Groups without points have no row."""
        return self._buckets(dimension(self.matching_series()))

    def _buckets(self, chosen: DataFrame) -> DataFrame:
        o = self.options
        result = buckets.bucketed(self.matching_writes(chosen), self.agg, self.width_ns, boundary=o.boundary, order=o.order, single=self.one_bucket(), writes=True)
        return result.withColumn("value", F.col("value").cast("float").cast("double")) if o.single_precision else result

    def build(self) -> Groups:
        """The groups of the result, to be read one by one."""
        chosen = dimension(self.matching_series())
        return Groups(staged(self._buckets(chosen)), chosen)

    def collect(self) -> dict[str, list[Bucket]]:
        """All groups with their buckets, newest first; groups without points have an empty list."""
        return self.build().collect()


def month_of(ts_ns: Column) -> Column:
    """``yyyy-MM`` of nanoseconds, in UTC whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_ns / F.lit(86_400_000_000_000)).cast("int"))
    return F.substring(day.cast("string"), 1, 7)


class Groups(Mapping):
    """Lazy access to the groups of a result: only the groups asked for are read to the driver."""

    def __init__(self, result: DataFrame, chosen: DataFrame):
        self.result, self.chosen = result, chosen

    def _names(self) -> DataFrame:
        return self.chosen.select("group").distinct()

    def __iter__(self) -> Iterator[str]:
        return (row["group"] for row in self._names().toLocalIterator())

    def __len__(self) -> int:
        return self._names().count()

    def __contains__(self, group: object) -> bool:
        return bool(self.chosen.where(F.col("group") == F.lit(group)).limit(1).count())

    def __getitem__(self, group: str) -> Iterator[Bucket]:
        if group not in self:
            raise KeyError(group)
        rows = self.result.where(F.col("group") == F.lit(group)).orderBy(F.desc("end"))
        return (_bucket(row) for row in rows.toLocalIterator())

    def collect(self) -> dict[str, list[Bucket]]:
        found: dict[str, list[Bucket]] = {name: [] for name in self}
        for row in self.result.orderBy("group", F.desc("end")).toLocalIterator():
            found[row["group"]].append(_bucket(row))
        return found


def _bucket(row: Row) -> Bucket:
    return Bucket(row["start"], row["end"], row["value"], row["len"])
