"""Second counts rendered as clock text, and integer averages.

All are built-in column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
_EPOCH = "1970-01-01 00:00:00"


def _wall_clock(seconds: Column) -> Column:
    """A TIMESTAMP_NTZ ``seconds`` after midnight of day 0 (no time zone involved)."""
    return F.timestamp_add("SECOND", seconds, F.lit(_EPOCH).cast("timestamp_ntz"))


def clock_time(seconds: Column) -> Column:
    """``HH:mm:ss`` of a second count taken modulo one day (a time of day).

    A total of 24 h or more wraps (90061 s -> ``01:01:01``), as a time-of-day
    value does; callers that need the total keep the raw seconds next to it.
    NULL in, NULL out.
    """
    return F.date_format(_wall_clock(F.pmod(seconds, F.lit(SECONDS_PER_DAY))), "HH:mm:ss")


def duration_text(seconds: Column) -> Column:
    """``[H:mm:ss]`` of a non-negative second count, hours unbounded.

    Used where a duration is appended to a resource name in the top-resource
    columns, so long totals must not wrap.
    """
    return F.concat(
        F.lit("["), F.floor(seconds / 3600).cast("string"), F.lit(":"),
        F.date_format(_wall_clock(seconds), "mm:ss"), F.lit("]"),
    )


def seconds_since(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end`` (``start`` is a midnight day value)."""
    return F.timestamp_diff("SECOND", start, end)


def truncated_avg(value: Column) -> Column:
    """Average of an integer column truncated toward zero, NULLs skipped:
    (1, 2, 2) -> 1, (-1, -2) -> -1, no value -> NULL. Integer division, so no
    total is too large to be exact."""
    return F.call_function("div", F.sum(value), F.nullif(F.count(value), F.lit(0)))
