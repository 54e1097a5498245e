"""Durations and times in integer nanoseconds."""

from __future__ import annotations

import math
import time

#: Nanoseconds of each unit. A month is four weeks and a year twelve months.
UNITS = {
    "nanos": 1,
    "micros": 1_000,
    "millis": 1_000_000,
    "seconds": 1_000_000_000,
    "minutes": 60_000_000_000,
    "hours": 3_600_000_000_000,
    "days": 86_400_000_000_000,
    "weeks": 604_800_000_000_000,
    "months": 2_419_200_000_000_000,
    "years": 29_030_400_000_000_000,
}


def duration(n: float, unit: str, truncate_first: bool = False) -> int:
    """``n`` units in nanoseconds, fractions included; negative and NaN amounts are 0.

    ``truncate_first`` drops the fraction of ``n`` before multiplying, so half a day is nothing.
    """
    if isinstance(n, float) and math.isnan(n) or n <= 0:
        return 0
    return int(n) * UNITS[unit] if truncate_first or isinstance(n, int) else int(n * UNITS[unit])


def nanos(n: float) -> int:
    return duration(n, "nanos")


def micros(n: float) -> int:
    return duration(n, "micros")


def millis(n: float) -> int:
    return duration(n, "millis")


def seconds(n: float) -> int:
    return duration(n, "seconds")


def minutes(n: float) -> int:
    return duration(n, "minutes")


def hours(n: float) -> int:
    return duration(n, "hours")


def days(n: float) -> int:
    return duration(n, "days")


def weeks(n: float) -> int:
    return duration(n, "weeks")


def months(n: float) -> int:
    return duration(n, "months")


def years(n: float) -> int:
    return duration(n, "years")


def timestamp() -> int:
    """Now, in nanoseconds since 1970-01-01 UTC."""
    return time.time_ns()
