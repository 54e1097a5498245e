"""Names of metrics and tags, and the text that identifies a series."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from chronoloom.errors import InvalidQuery

#: Fixed value: the letters a metric name may have.
METRIC_NAME = re.compile(r"[a-z_.]*\Z")


class MetricName(str):
    """A metric name: lower-case letters, ``_`` and ``.`` only, and not empty."""

    def __new__(cls, name: str, allow_empty: bool = False) -> MetricName:
        if not METRIC_NAME.match(name) or not (name or allow_empty):
            raise InvalidQuery(f"invalid metric name: {name!r}")
        return super().__new__(cls, name)


def is_metric_name(column: Column) -> Column:
    """Column form of the rule for metric names."""
    return column.rlike(r"^[a-z_.]+$")


def tagset(**tags: str) -> dict[str, str]:
    """A set of tags from keywords: ``tagset(host="h-1", env="prod")``."""
    return check_tags(tags)


def check_tags(tags: Mapping[str, str]) -> dict[str, str]:
    """Tags as a dict. Characters that would make the text form ambiguous are refused."""
    for key, value in tags.items():
        if not key or value is None or set(key) & set(";:") or ";" in value:
            raise InvalidQuery(f"invalid tag {key!r}: {value!r}")
    return dict(tags)


def join_tags(tags: Mapping[str, str]) -> str:
    """``k:v;k:v``, sorted by key."""
    return ";".join(f"{k}:{v}" for k, v in sorted(tags.items()))


def series_key(metric: str, tags: Mapping[str, str]) -> str:
    """``metric#k:v;k:v``: the identity of a series."""
    return f"{metric}#{join_tags(tags)}"


def term(metric: str, key: str, value: str) -> str:
    """Index term of one tag of a metric."""
    return f"{metric}#{key}:{value}"


def parse_tags(text: str) -> dict[str, str]:
    """The tags of a ``k:v;k:v`` text; the first colon ends the key. The empty text is no tags."""
    return dict(pair.split(":", 1) for pair in text.split(";")) if text else {}


def join_tags_column(tags: Column) -> Column:
    """Column form of :func:`join_tags`; a null map is no tags."""
    entries = F.array_sort(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";")


def series_key_column(metric: Column, tags: Column) -> Column:
    """Column form of :func:`series_key`."""
    return F.concat(metric, F.lit("#"), join_tags_column(tags))


def term_column(metric: Column, key: Column, value: Column) -> Column:
    """Column form of :func:`term`."""
    return F.concat(metric, F.lit("#"), key, F.lit(":"), value)


def parse_tags_column(text: Column) -> Column:
    """Column form of :func:`parse_tags`."""
    pairs = F.filter(F.split(text, ";"), lambda p: p != "")

    def entry(pair: Column) -> Column:
        return F.struct(F.substring_index(pair, ":", 1).alias("key"), F.regexp_replace(pair, "^[^:]*:", "").alias("value"))

    return F.map_from_entries(F.transform(pairs, entry))
