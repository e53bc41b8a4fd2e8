"""Time reports per user: monthly totals, resource-by-hour usage, and the
per-user report with top resources, machines and day averages, by month or
over the whole period.

The monthly and the whole-period report are one implementation with a
``monthly`` switch; their other differences (weekday ranges, date bounds,
how the machine list is attached) are explicit fields of
:class:`ReportParams`, with the two original sets of values as presets.
"""

from __future__ import annotations

import dataclasses
import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.functions.calendar import first_of_month
from worklens.functions import (
    NOCASE,
    Names,
    clock_time,
    duration_text,
    in_work_hours,
    month_start,
    name_key,
    not_lock_screen,
    ntz,
    truncated_avg,
    without_prefix,
)
from worklens.operators.rollup import (
    day_resource_measures,
    merged,
    reportable,
    user_day_totals,
    user_day_work_hours,
    work_hour_days,
    work_hour_measures,
)
from worklens.plans.distributed import materialize

# Fixed values of the original reports.
WORK_HOURS = (9, 19)              # hour buckets 9..19, both ends inclusive
MON_TO_SAT = (2, 7)               # weekday numbers with Sunday = 1
MON_TO_FRI = (2, 6)
TOP_RESOURCES = 6
USAGE_TYPE_LABELS = {1: "Productive", 2: "UnProductive", 3: "Neutral"}  # anything else: Undefined
USAGE_OTHER_LABEL = "Undefined"
NO_DEPARTMENT = "-"
NO_COMPUTERS = "-"
MACHINE_SEPARATOR = "; "


@dataclasses.dataclass(frozen=True)
class ReportParams:
    monthly: bool
    sessions_since: _dt.datetime
    day_from: _dt.datetime
    day_until: _dt.datetime
    work_hours: tuple[int, int] = WORK_HOURS
    top_weekdays: tuple[int, int] = MON_TO_SAT
    day_weekdays: tuple[int, int] = MON_TO_FRI
    top_k: int = TOP_RESOURCES
    names: Names = NOCASE

    @property
    def keys(self) -> list[str]:
        return ["system_user", "y", "m"] if self.monthly else ["system_user"]


def monthly_params(**overrides) -> ReportParams:
    """The monthly report's values: Mon-Sat for top resources, Mon-Fri for
    day work hours, sessions from 2018-08-01, days 2018-08-01..2018-12-31."""
    base = dict(
        monthly=True,
        sessions_since=_dt.datetime(2018, 8, 1),
        day_from=_dt.datetime(2018, 8, 1),
        day_until=_dt.datetime(2018, 12, 31),
        top_weekdays=MON_TO_SAT,
        day_weekdays=MON_TO_FRI,
    )
    base.update(overrides)
    return ReportParams(**base)


def period_params(as_of: _dt.datetime, **overrides) -> ReportParams:
    """The whole-period report's values: Mon-Sat throughout, sessions and days
    from 2018-06-01, days up to ``as_of``."""
    base = dict(
        monthly=False,
        sessions_since=_dt.datetime(2018, 6, 1),
        day_from=_dt.datetime(2018, 6, 1),
        day_until=as_of,
        top_weekdays=MON_TO_SAT,
        day_weekdays=MON_TO_SAT,
    )
    base.update(overrides)
    return ReportParams(**base)


def _year_month(y: Column, m: Column) -> Column:
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"))


def _with_ym(df: DataFrame, day_col: str) -> DataFrame:
    return df.withColumns({"y": F.year(day_col), "m": F.month(day_col)})


# --------------------------------------------------------------------------- #
# Monthly totals and resource-by-hour usage
# --------------------------------------------------------------------------- #

_TOTALS = ["sum_daily_duration", "sum_productive", "sum_distracting", "sum_neutral", "sum_undefined"]


def user_month_totals(detail: DataFrame, base: DataFrame, users: DataFrame, names: Names = NOCASE) -> DataFrame:
    """Per (month, user): days observed, total time per type (clock text that
    wraps past 24 h, plus ``*_seconds``), and the average first start / last end.
    """
    return month_totals(user_day_totals(detail, base, names), users)


def month_totals(days: DataFrame, users: DataFrame) -> DataFrame:
    """:func:`user_month_totals` from :func:`user_day_totals`."""
    days = _with_ym(days, "date")
    month = days.groupBy("system_user", "y", "m").agg(
        F.count(F.lit(1)).alias("number_of_days_observed"),
        *[F.sum(c).alias(c + "_seconds") for c in _TOTALS],
        truncated_avg(F.col("min_activity_start_seconds")).alias("average_start_seconds"),
        truncated_avg(F.col("max_activity_end_seconds")).alias("average_end_seconds"),
    )
    named = month.join(users.select(F.col("oid").alias("system_user"), "name"), "system_user")
    return named.select(
        _year_month(F.col("y"), F.col("m")).alias("year_month"),
        "number_of_days_observed", "name", "system_user",
        *[clock_time(F.col(c + "_seconds")).alias(c) for c in _TOTALS],
        clock_time(F.col("average_start_seconds")).alias("average_start_time"),
        clock_time(F.col("average_end_seconds")).alias("average_end_time"),
        *[c + "_seconds" for c in _TOTALS],
        "average_start_seconds", "average_end_seconds",
    )


def usage_type_label(ptype: Column) -> Column:
    out = None
    for code, label in USAGE_TYPE_LABELS.items():
        out = (F.when(ptype == code, F.lit(label)) if out is None else out.when(ptype == code, F.lit(label)))
    return out.otherwise(F.lit(USAGE_OTHER_LABEL))


def resource_hour_usage(detail: DataFrame, base: DataFrame, users: DataFrame,
                        after: _dt.datetime = _dt.datetime(2018, 10, 1),
                        domain_prefix: str = "", limit: int | None = None, names: Names = NOCASE) -> DataFrame:
    """Per (user, month, resource name, hour bucket, productivity type): time used.

    Days strictly after ``after``; the lock screen is excluded. The user is
    shown by friendly name, else by account name without ``domain_prefix``.
    Detail rows are summed per catalogue id before the catalogue and user
    joins (which then see one row per id, month, hour and type), and summed
    again per resource *name*, since names are not unique in the catalogue.
    ``limit`` keeps the first rows in key order (the original report showed an
    arbitrary 100); ``None`` returns every row.
    """
    per_id = (
        detail.where(F.col("date") > ntz(after))
        .groupBy(
            "system_user", "productivity_base", month_start(F.col("date")).alias("month"),
            "hour_from", "adjusted_productivity_type",
        )
        .agg(F.sum("daily_duration").alias("duration"))
    )
    resources = base.where(not_lock_screen(F.col("resource_name"), names=names)).select(
        F.col("id").alias("productivity_base"), "resource_name"
    )
    accounts = users.select(F.col("oid").alias("system_user"), "name", "friendly_name")
    joined = per_id.join(resources, "productivity_base").join(accounts, "system_user")
    usage = joined.groupBy(
        "system_user", "name", "friendly_name", "month",
        name_key(F.col("resource_name"), names).alias("resource_key"), "hour_from", "adjusted_productivity_type",
    ).agg(F.sum("duration").alias("duration"), F.min("resource_name").alias("resource_name"))
    out = usage.select(
        "resource_name",
        F.coalesce(F.col("friendly_name"), without_prefix(F.col("name"), domain_prefix, names)).alias("name"),
        "duration", "hour_from",
        usage_type_label(F.col("adjusted_productivity_type")).alias("productivity_type"),
        "month", "system_user", "adjusted_productivity_type", "resource_key",
    )
    if limit is not None:
        out = out.orderBy(
            F.asc_nulls_first("system_user"), F.asc_nulls_first("month"), F.asc_nulls_first("resource_key"),
            F.asc_nulls_first("hour_from"), F.asc_nulls_first("adjusted_productivity_type"),
        ).limit(limit)
    return out.drop("resource_key")


# --------------------------------------------------------------------------- #
# Per-user report (monthly or whole period)
# --------------------------------------------------------------------------- #


def _in_months(rows: DataFrame, column: str, months: tuple[_dt.datetime, _dt.datetime] | None) -> DataFrame:
    if months is None:
        return rows
    return rows.where((F.col(column) >= ntz(months[0])) & (F.col(column) < ntz(months[1])))


def report_months(params: ReportParams) -> tuple[_dt.datetime, _dt.datetime] | None:
    """For the monthly report: ``[first of day_from's month, first of the
    month after day_until)``, the only months whose rows can reach the report."""
    if not params.monthly:
        return None
    return first_of_month(params.day_from), first_of_month(params.day_until, months_ahead=1)


def session_window(params: ReportParams) -> tuple[_dt.datetime, _dt.datetime | None]:
    """The first and last moment of sessions that can reach the report (None: no end)."""
    months = report_months(params)
    if months is None:
        return params.sessions_since, None
    return max(params.sessions_since, months[0]), months[1]


def resource_measures(params: ReportParams) -> list[Column]:
    work = in_work_hours(F.col("date"), F.col("hour_from"), params.work_hours, params.top_weekdays)
    return [F.sum(F.when(work, F.col("daily_duration")).otherwise(F.lit(0))).alias("sum_work"),
            F.sum("daily_duration").alias("sum_all")]


def _resource_times(rows: DataFrame, params: ReportParams) -> DataFrame:
    return rows.withColumnsRenamed({"sum_work": "work_duration", "sum_all": "all_duration"}).withColumns({
        "work_duration_time": duration_text(F.col("work_duration")),
        "all_duration_time": duration_text(F.col("all_duration")),
    })


def user_resource_time(detail: DataFrame, base: DataFrame, params: ReportParams,
                       months: tuple[_dt.datetime, _dt.datetime] | None = None) -> DataFrame:
    """Per user x resource (x month): time inside work hours on the top-resource
    weekdays, and all time. No date bound (as in the original report) unless
    ``months`` restricts it to whole months ``[start, end)``. Detail rows are
    summed before the catalogue filter."""
    rows = _in_months(detail, "date", months)
    if params.monthly:
        rows = _with_ym(rows, "date")
    sums = rows.groupBy(*params.keys, "productivity_base").agg(*resource_measures(params))
    return _resource_times(reportable(sums, base, params.names), params)


def top_resources(resource_time: DataFrame, params: ReportParams) -> DataFrame:
    """The ``top_k`` resources per user (x month) by work-hour time, ranked
    1..k in ``rn_work_hours``; ties go to the lower catalogue id.

    The rank filter on a row_number with a literal bound plans as a
    WindowGroupLimit, so each map task keeps only k rows per key before the
    window shuffle completes the ranking.
    """
    order = Window.partitionBy(*params.keys).orderBy(
        F.desc_nulls_last("work_duration"), F.asc_nulls_first("productivity_base")
    )
    return (
        resource_time.withColumn("rn_work_hours", F.row_number().over(order))
        .where(F.col("rn_work_hours") <= params.top_k)
    )


def user_machines(sessions: DataFrame, params: ReportParams,
                  months: tuple[_dt.datetime, _dt.datetime] | None = None) -> DataFrame:
    """Per user (x month): number of distinct machines and the list
    ``name[sessions]; ...`` in name order. Sessions from ``sessions_since``
    (and within whole ``months`` when given).

    A NULL machine counts in ``computers_count`` but is left out of the list;
    a user with only NULL machines gets a NULL list.
    """
    rows = _in_months(sessions.where(F.col("save_date") >= ntz(params.sessions_since)), "save_date", months)
    if params.monthly:
        rows = _with_ym(rows, "save_date")
    # Count per exact spelling first (a hash aggregate over the session rows,
    # combined map-side); the case-insensitive merge and its smallest spelling
    # then run on one row per spelling.
    per_spelling = rows.groupBy(*params.keys, "machine_name").agg(F.count(F.lit(1)).alias("n"))
    per_machine = per_spelling.groupBy(*params.keys, name_key(F.col("machine_name"), params.names).alias("machine_key")).agg(
        F.sum("n").alias("n"), F.min("machine_name").alias("machine_name")
    ).select(
        *params.keys,
        F.concat(F.col("machine_name"), F.lit("["), F.col("n").cast("string"), F.lit("]")).alias("machine_label"),
    )
    order = "machine_label" if params.names.heeds_case else "lower(machine_label), machine_label"
    return (
        per_machine.where(F.col("system_user").isNotNull())
        .groupBy(*params.keys)
        .agg(
            F.count(F.lit(1)).alias("computers_count"),
            F.expr(
                f"listagg(machine_label, '{MACHINE_SEPARATOR}') "
                f"WITHIN GROUP (ORDER BY {order})"
            ).alias("computer_names"),
        )
    )


_AVG_DURATIONS = ["daily_duration", "productive", "distracting", "neutral", "undefined"]


def user_day_averages(detail: DataFrame, base: DataFrame, users: DataFrame, params: ReportParams) -> DataFrame:
    """Per user (x month): days observed and the average day, inside work hours
    (``_wh``) and overall, as clock text.

    Durations average with a day lacking that time counted as 0; start and
    end average over the days that have them. The whole-period version adds
    the first and last day observed.
    """
    days = user_day_work_hours(detail, base, params.day_from, params.day_until,
                               params.work_hours, params.day_weekdays, params.names)
    return _day_averages(days, users, params).drop("working_department")


def _day_averages(days: DataFrame, users: DataFrame, params: ReportParams) -> DataFrame:
    """The averages of :func:`user_day_averages`, with the user's department."""
    if params.monthly:
        days = _with_ym(days, "date")

    measures = []
    for suffix in ("_wh", ""):
        for name in _AVG_DURATIONS:
            measures.append(
                clock_time(truncated_avg(F.coalesce(F.col(f"sum_{name}{suffix}"), F.lit(0))))
                .alias(f"avg_{name}{suffix}")
            )
        measures.append(clock_time(truncated_avg(F.col(f"min_activity_start_seconds{suffix}")))
                        .alias(f"average_start_time{suffix}"))
        measures.append(clock_time(truncated_avg(F.col(f"max_activity_end_seconds{suffix}")))
                        .alias(f"average_end_time{suffix}"))
    extra = [] if params.monthly else [F.min("date").alias("min_date"), F.max("date").alias("max_date")]
    agg = days.groupBy(*params.keys).agg(F.count(F.lit(1)).alias("number_of_days_observed"), *extra, *measures)
    named = agg.join(users.select(F.col("oid").alias("system_user"), "name", "working_department"), "system_user")
    if params.monthly:
        named = named.withColumn("year_month", _year_month(F.col("y"), F.col("m")))
    return named


def top_resources_pivot(top: DataFrame, base: DataFrame, params: ReportParams) -> DataFrame:
    """One row per user (x month) with ``t1..tk`` = resource name followed by
    its work-hour time, by rank (NULL where there is no such rank)."""
    labelled = top.join(
        base.select(F.col("id").alias("productivity_base"), "resource_name"), "productivity_base"
    ).select(
        *params.keys, "rn_work_hours",
        F.concat(F.col("resource_name"), F.col("work_duration_time")).alias("work_activity_with_time"),
    )
    ranks = list(range(1, params.top_k + 1))
    if not ranks:
        return labelled.select(*params.keys).distinct()
    pivoted = labelled.groupBy(*params.keys).pivot("rn_work_hours", ranks).agg(F.max("work_activity_with_time"))
    return pivoted.select(*params.keys, *[F.col(str(k)).alias(f"t{k}") for k in ranks])


_REPORT_TIMES = [
    "avg_daily_duration_wh", "avg_productive_wh", "avg_distracting_wh", "avg_neutral_wh", "avg_undefined_wh",
    "average_start_time_wh", "average_end_time_wh",
    "avg_daily_duration", "avg_productive", "avg_distracting", "avg_neutral", "avg_undefined",
    "average_start_time", "average_end_time",
]


def user_report(detail: DataFrame, base: DataFrame, users: DataFrame, department: DataFrame,
                sessions: DataFrame, params: ReportParams, sums: DataFrame | None = None) -> DataFrame:
    """The per-user report: day averages, department, machines and top resources.

    Monthly: machines attach through the top-resource row of the same month
    (no top-resource row, no machines); ``computers_count`` stays numeric.
    Whole period: machines attach to the user directly and the count is text
    with ``-`` when absent. Users without a department show ``-``. All joins
    after the two detail aggregations are on per-user(-month) rows.

    Monthly, top resources and machines are only computed for the whole
    months around ``[day_from, day_until]``: rows of other months could only
    join month rows the report does not have. This bounds the otherwise
    history-wide resource scan (and prunes day partitions).

    The detail table is scanned once: the measures of both halves are summed
    per (date, user, resource), filtered by the catalogue and written to
    shared storage, and both halves merge these sums. Where the sums are kept
    (``sums``, see ``worklens.plans.day_sums``) no detail is read.
    """
    keys = params.keys
    months = report_months(params)
    if sums is None:
        sums = materialize(
            reportable(day_resource_measures(
                _in_months(detail, "date", months),
                [*work_hour_measures(params.work_hours, params.day_weekdays), *resource_measures(params)]), base, params.names),
            "report-sums")
    else:
        sums = materialize(reportable(_in_months(sums, "date", months), base, params.names), "report-sums")
    days = work_hour_days(sums.where(F.col("date").between(ntz(params.day_from), ntz(params.day_until))))
    report = _day_averages(days, users, params)
    per_resource = _with_ym(sums, "date") if params.monthly else sums
    times = _resource_times(merged(per_resource, [*keys, "productivity_base"], ["sum_work", "sum_all"]), params)
    pivot = top_resources_pivot(top_resources(times, params), base, params)
    machines = user_machines(sessions, params, months)
    if params.monthly:
        report = report.join(pivot.join(machines, keys, "left"), keys, "left")
    else:
        report = report.join(pivot, keys, "left").join(machines, keys, "left")
    report = (
        report.join(
            department.select(F.col("oid").alias("working_department"), F.col("name").alias("department_name")),
            "working_department", "left",
        )
    )
    ranks = [f"t{k}" for k in range(1, params.top_k + 1)]
    department_col = F.coalesce(F.col("department_name"), F.lit(NO_DEPARTMENT)).alias("department")
    if params.monthly:
        return report.select(
            F.col("name").alias("user_name"), "year_month", "number_of_days_observed", department_col,
            "computers_count", *_REPORT_TIMES, "computer_names", *ranks,
        ).orderBy(F.desc("year_month"), F.asc("user_name"))
    return report.select(
        F.col("name").alias("user_name"), "number_of_days_observed", department_col,
        F.coalesce(F.col("computers_count").cast("string"), F.lit(NO_COMPUTERS)).alias("computers_count"),
        "min_date", "max_date", *_REPORT_TIMES, "computer_names", *ranks,
    ).orderBy(F.asc("user_name"))
