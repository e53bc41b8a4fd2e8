"""Per-user, per-day roll-ups and roll-up integrity checks.

* :func:`pending_rollup_count` - activity still waiting to be rolled up.
* :func:`rollup_drift` - detail rows whose linked activity exceeds them.
* :func:`user_day_totals` - per (date, user) span and time per productivity type.
* :func:`user_day_work_hours` - the same measures, once over all rows and once
  over work-hour rows, in one pass (conditional aggregation instead of a
  self-join of the detail table on its key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions import (
    NOCASE,
    Names,
    clock_time,
    in_work_hours,
    not_lock_screen,
    ntz,
    seconds_since,
)

PRODUCTIVE, DISTRACTING, NEUTRAL, UNDEFINED = 1, 2, 3, 0
# The object type of an activity row that is rolled up into the detail table.
ROLLED_UP_OBJECT_TYPE = 8


def pending_rollup_count(activity: DataFrame, object_type: int = ROLLED_UP_OBJECT_TYPE) -> DataFrame:
    """One row, ``pending_count``: rolled-up activity not yet linked to a detail row."""
    return (
        activity.where(
            (F.col("object_type") == object_type)
            & F.col("user_productivity_daily_detail").isNull()
            & F.col("productivity_base").isNotNull()
            & (F.col("inactivity_set") == 1)
            & (F.col("active_duration") > 0)
        )
        .agg(F.count(F.lit(1)).alias("pending_count"))
    )


def rollup_drift(detail: DataFrame, activity: DataFrame, tolerance_seconds: int = 2) -> DataFrame:
    """Detail rows whose linked activity adds up to more than ``daily_duration + tolerance``.

    Activity is summed per detail key *before* the join (partial aggregation
    runs map-side, so a detail key holding a large share of the activity costs
    one row per map task in the shuffle), then joined to the detail table on
    its key. Detail rows with no activity, or with a NULL duration, are never
    reported. Ordered by the difference.
    """
    per_detail = (
        activity.where(F.col("user_productivity_daily_detail").isNotNull())
        .groupBy(F.col("user_productivity_daily_detail").alias("oid"))
        .agg(F.sum("active_duration").alias("sum_active_duration"))
    )
    return (
        detail.select("oid", "date", "daily_duration")
        .join(per_detail, "oid")
        .where(F.col("sum_active_duration") > F.col("daily_duration") + tolerance_seconds)
        .select(
            "oid", "date", "sum_active_duration",
            F.col("daily_duration").cast("bigint").alias("daily_duration"),
            (F.col("sum_active_duration") - F.col("daily_duration")).alias("diff_duration"),
        )
        .orderBy("diff_duration", "oid")
    )


def reportable(rows: DataFrame, base: DataFrame, names: Names = NOCASE) -> DataFrame:
    """Rows whose resource is in the catalogue and is not the lock screen.

    The catalogue id is its key, so the inner join of the original reports is
    a semi-join on the qualifying ids: no catalogue column is carried along.
    Callers pass rows that are already summed per resource, so the shuffle by
    resource, whose keys are hot, moves groups and no detail rows.
    """
    keep = base.where(not_lock_screen(F.col("resource_name"), names=names)).select(F.col("id").alias("productivity_base"))
    return rows.join(keep, "productivity_base", "left_semi")


def _span_and_type_sums(rows: Column | None, suffix: str, else_zero: bool,
                        null_type_is_undefined: bool) -> list[Column]:
    """Measures of one (date, user) group, restricted to ``rows`` when given."""
    def only(value: Column) -> Column:
        return value if rows is None else F.when(rows, value)

    ptype = F.col("adjusted_productivity_type")
    duration = F.col("daily_duration")
    undefined_type = F.coalesce(ptype, F.lit(UNDEFINED)) if null_type_is_undefined else ptype

    def typed_sum(cond: Column, name: str) -> Column:
        if rows is not None:
            cond = cond & rows
        value = F.when(cond, duration)
        if else_zero:
            value = value.otherwise(F.lit(0))
        return F.sum(value).alias(name + suffix)

    start = F.min(only(F.col("activity_start")))
    end = F.max(only(F.col("activity_end")))
    return [
        start.alias("min_activity_start" + suffix),
        end.alias("max_activity_end" + suffix),
        F.sum(only(duration)).alias("sum_daily_duration" + suffix),
        typed_sum(ptype == PRODUCTIVE, "sum_productive"),
        typed_sum(ptype == DISTRACTING, "sum_distracting"),
        typed_sum(ptype == NEUTRAL, "sum_neutral"),
        typed_sum(undefined_type == UNDEFINED, "sum_undefined"),
    ]


def day_resource_measures(detail: DataFrame, measures: list[Column]) -> DataFrame:
    """``measures`` per (date, user, resource), combined map-side."""
    return detail.groupBy("date", "system_user", "productivity_base").agg(*measures)


def merged(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Measures of finer groups merged per ``keys``: their prefix (``min_``, ``max_``, ``sum_``) says how."""
    how = {"min": F.min, "max": F.max, "sum": F.sum}
    return rows.groupBy(*keys).agg(*[how[n.split("_")[0]](n).alias(n) for n in names])


def _with_second_of_day(df: DataFrame, suffix: str) -> DataFrame:
    start_s = seconds_since(F.col("date"), F.col("min_activity_start" + suffix))
    end_s = seconds_since(F.col("date"), F.col("max_activity_end" + suffix))
    return df.withColumns({
        "min_activity_start_seconds" + suffix: start_s,
        "max_activity_end_seconds" + suffix: end_s,
        "min_activity_start_time" + suffix: clock_time(start_s),
        "max_activity_end_time" + suffix: clock_time(end_s),
    })


DAY_MEASURES = [
    "min_activity_start", "max_activity_end",
    "min_activity_start_time", "max_activity_end_time",
    "min_activity_start_seconds", "max_activity_end_seconds",
    "sum_daily_duration", "sum_productive", "sum_distracting", "sum_neutral", "sum_undefined",
]


_SPAN_AND_SUMS = ["min_activity_start", "max_activity_end", "sum_daily_duration", "sum_productive",
                  "sum_distracting", "sum_neutral", "sum_undefined"]


def user_day_totals(detail: DataFrame, base: DataFrame, names: Names = NOCASE) -> DataFrame:
    """Per (date, user): first start, last end (timestamp, seconds of day and
    clock text), total time and time per productivity type.

    Type buckets sum 0 for other types; a NULL type counts in the total only.
    Detail rows are summed per resource before the catalogue filter.
    """
    per_resource = day_resource_measures(
        detail, _span_and_type_sums(None, "", else_zero=True, null_type_is_undefined=False))
    return day_totals(reportable(per_resource, base, names))


def day_totals(per_resource: DataFrame) -> DataFrame:
    """:func:`user_day_totals` from sums per (date, user, resource)."""
    day = merged(per_resource, ["date", "system_user"], _SPAN_AND_SUMS)
    return _with_second_of_day(day, "").select("date", "system_user", *DAY_MEASURES)


def plain_type_sums(suffix: str) -> list[Column]:
    """The type sums of :func:`user_day_totals` (0 for other types, NULL types in none)."""
    return _span_and_type_sums(None, suffix, else_zero=True, null_type_is_undefined=False)[3:]


def work_hour_measures(work_hours: tuple[int, int] = (9, 19),
                       work_weekdays: tuple[int, int] = (2, 6)) -> list[Column]:
    """The day measures over all rows and, suffixed ``_wh``, over rows inside work hours."""
    wh = in_work_hours(F.col("date"), F.col("hour_from"), work_hours, work_weekdays)
    return [*_span_and_type_sums(None, "", else_zero=False, null_type_is_undefined=True),
            *_span_and_type_sums(wh, "_wh", else_zero=False, null_type_is_undefined=True)]


def work_hour_days(per_resource: DataFrame) -> DataFrame:
    """:func:`work_hour_measures` per (date, user, resource) merged per (date, user)."""
    day = merged(per_resource, ["date", "system_user"], [*_SPAN_AND_SUMS, *[n + "_wh" for n in _SPAN_AND_SUMS]])
    day = _with_second_of_day(_with_second_of_day(day, ""), "_wh")
    return day.select("date", "system_user", *DAY_MEASURES, *[c + "_wh" for c in DAY_MEASURES])


def user_day_work_hours(detail: DataFrame, base: DataFrame, day_from, day_until,
                        work_hours: tuple[int, int] = (9, 19),
                        work_weekdays: tuple[int, int] = (2, 6), names: Names = NOCASE) -> DataFrame:
    """Per (date, user) in ``[day_from, day_until]``: the day measures over all
    rows and, suffixed ``_wh``, over rows inside work hours on work weekdays.

    Type buckets are NULL when no row of that type exists; a NULL type counts
    as Undefined. A day without work-hour rows has NULL ``_wh`` measures.
    One scan; the row-level work-hour flag replaces a left self-join on the
    detail key (exact because ``oid`` is unique).
    """
    rows = detail.where(F.col("date").between(ntz(day_from), ntz(day_until)))
    sums = day_resource_measures(rows, work_hour_measures(work_hours, work_weekdays))
    return work_hour_days(reportable(sums, base, names))
