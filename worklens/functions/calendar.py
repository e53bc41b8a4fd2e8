"""Calendar expressions and parameter literals."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

def ntz(value: str | _dt.date | _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (time-zone independent)."""
    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = value
    return F.lit(text).cast("timestamp_ntz")


def weekday(day: Column) -> Column:
    """Day of week, Sunday = 1 .. Saturday = 7."""
    return F.dayofweek(day)


def in_work_hours(day: Column, hour_from: Column, hours: tuple[int, int],
                  weekdays: tuple[int, int]) -> Column:
    """Hour bucket and weekday both inside their inclusive ranges."""
    return weekday(day).between(*weekdays) & hour_from.between(*hours)


def month_start(day: Column) -> Column:
    """First day of the month at midnight, TIMESTAMP_NTZ."""
    return F.trunc(day.cast("date"), "month").cast("timestamp_ntz")


def first_of_month(value: _dt.date | _dt.datetime, months_ahead: int = 0) -> _dt.datetime:
    """Midnight of the first day of the month ``months_ahead`` after ``value`` (driver-side parameter)."""
    month_index = value.year * 12 + (value.month - 1) + months_ahead
    return _dt.datetime(month_index // 12, month_index % 12 + 1, 1)
