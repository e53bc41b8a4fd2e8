"""Registered jobs: one Spark callable ``(spark, sf_dir) -> DataFrame`` and one
oracle SQL statement per key.

Every job reads the fixture tables derived from the whole of the driver's
tables at ``sf_dir``. Parameters that the original scripts hard-code to 2018
dates are moved onto the fixtures' calendar (January to April 2024) and chosen
so the whole fixture range is in scope.
"""

from __future__ import annotations

import dataclasses
import datetime as _dt
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from worklens import oracle
from worklens.functions import BINARY
from worklens.operators import access, departments, reports, rollup
from worklens.plans import day_sums
from worklens.plans import reclassify as reclassify_job
from worklens.plans.user_reports import user_report
from worklens.session import configure, ensure_checkpoint_dir
from worklens.sources.fixtures import fixture_tables
from worklens.sources.tables import Tables, read_tables, write_version

# Fixture parameters (see module docstring).
AS_OF = _dt.datetime(2024, 6, 1)
USAGE_AFTER = _dt.datetime(2023, 12, 31)
DOMAIN_PREFIX = "CORP/"
USAGE_PREVIEW_ROWS = 100
# Viewer 0 has a usable filtering group in every fixture scale; account -1
# has no group link at all (so every active user is visible). Dates pass
# through the report window rule: the end (after 2020-01-01) becomes the
# first of the month after AS_OF.
VIEWER_WITH_GROUPS = 0
VIEWER_WITHOUT_GROUPS = -1
DEFAULT_VIEWER = 0
DEPARTMENT_FROM = _dt.datetime(2024, 1, 1)
EARLY_START, EARLY_AS_OF = _dt.datetime(2015, 6, 1), _dt.datetime(2024, 3, 15)
DEPARTMENT_UNTIL = _dt.datetime(2024, 5, 1)
MONTHLY = reports.monthly_params(
    sessions_since=_dt.datetime(2024, 1, 1),
    day_from=_dt.datetime(2024, 1, 1),
    day_until=_dt.datetime(2024, 4, 30),
)
PERIOD = reports.period_params(
    as_of=AS_OF,
    sessions_since=_dt.datetime(2024, 1, 1),
    day_from=_dt.datetime(2024, 1, 1),
)

Job = Callable[[SparkSession, str], DataFrame]


@functools.lru_cache(maxsize=8)
def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The fixture tables of one session and directory, opened once.

    Only the (lazy, immutable) DataFrame plans are kept; every job still reads
    the parquet files when it runs.
    """
    return fixture_tables(configure(spark), sf_dir)


def _job(build: Callable[[Tables], DataFrame]) -> Job:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(_tables(spark, sf_dir))
    run.__doc__ = build.__doc__
    return run


def _report_jobs(suffix: str, p: reports.ReportParams) -> dict[str, tuple[Job, str]]:
    return {
        f"user_resource{suffix}_time": (
            _job(lambda t: reports.user_resource_time(t.detail, t.base, p)),
            oracle.user_resource_time(p),
        ),
        f"top_resources{suffix}": (
            _job(lambda t: reports.top_resources(reports.user_resource_time(t.detail, t.base, p), p)),
            oracle.top_resources(p),
        ),
        f"user_machines{suffix}": (
            _job(lambda t: reports.user_machines(t.between("user_session", p.sessions_since), p)),
            oracle.user_machines(p),
        ),
        ("user_day_work_hours" if p.monthly else "user_day_work_hours_period"): (
            _job(lambda t: rollup.user_day_work_hours(t.detail, t.base, p.day_from, p.day_until,
                                                      p.work_hours, p.day_weekdays)),
            oracle.user_day_work_hours(p),
        ),
        ("user_month_averages" if p.monthly else "user_period_averages"): (
            _job(lambda t: reports.user_day_averages(t.detail, t.base, t.users, p)),
            oracle.user_day_averages(p),
        ),
        f"top_resources_pivot{suffix}": (
            _job(lambda t: reports.top_resources_pivot(
                reports.top_resources(reports.user_resource_time(t.detail, t.base, p), p), t.base, p)),
            oracle.top_resources_pivot(p),
        ),
        ("user_month_report" if p.monthly else "user_period_report"): (
            _job(lambda t: user_report(t, p)),
            oracle.user_report(p),
        ),
    }


def _jobs() -> dict[str, tuple[Job, str | None]]:
    jobs: dict[str, tuple[Job, str | None]] = {
        "pending_rollup_count": (
            _job(lambda t: rollup.pending_rollup_count(t.activity)),
            oracle.pending_rollup_count(),
        ),
        "rollup_drift": (
            _job(lambda t: rollup.rollup_drift(t.detail, t.activity, tolerance_seconds=2)),
            oracle.rollup_drift(2),
        ),
        "user_day_totals": (
            _job(lambda t: rollup.user_day_totals(t.detail, t.base)),
            oracle.user_day_totals(),
        ),
        "user_month_totals": (
            _job(lambda t: reports.user_month_totals(t.detail, t.base, t.users)),
            oracle.user_month_totals(),
        ),
        "resource_hour_usage": (
            _job(lambda t: reports.resource_hour_usage(t.detail, t.base, t.users, USAGE_AFTER, DOMAIN_PREFIX)),
            oracle.resource_hour_usage(USAGE_AFTER, DOMAIN_PREFIX),
        ),
        "resource_hour_usage_top100": (
            _job(lambda t: reports.resource_hour_usage(t.detail, t.base, t.users, USAGE_AFTER, DOMAIN_PREFIX,
                                                       limit=USAGE_PREVIEW_ROWS)),
            oracle.resource_hour_usage(USAGE_AFTER, DOMAIN_PREFIX, limit=USAGE_PREVIEW_ROWS),
        ),
    }
    jobs.update(_report_jobs("_month", MONTHLY))
    jobs.update(_report_jobs("", PERIOD))
    jobs.update(_visibility_jobs())
    jobs.update(_reclassify_jobs())
    return jobs


def _visible(t: Tables, viewer, default_viewer=DEFAULT_VIEWER) -> DataFrame:
    return access.visible_users(t.users, t.system_user_to_group, t.filtering_group, t.app_user_to_group,
                                viewer, default_viewer)


def _department(t: Tables, viewer, first: _dt.datetime = DEPARTMENT_FROM, as_of: _dt.datetime = AS_OF) -> DataFrame:
    date_from, date_until = access.report_window(first, DEPARTMENT_UNTIL, as_of)
    return departments.department_productivity(
        t.detail, t.daily, t.users, t.department, t.base, _visible(t, viewer), date_from, date_until,
        dates_agree=t.proves("dates_agree"),
    )


def _visibility_jobs() -> dict[str, tuple[Job, str | None]]:
    return {
        "visible_users": (
            _job(lambda t: _visible(t, VIEWER_WITH_GROUPS)),
            oracle.visible_users(VIEWER_WITH_GROUPS, DEFAULT_VIEWER),
        ),
        "visible_users_unfiltered": (
            _job(lambda t: _visible(t, VIEWER_WITHOUT_GROUPS)),
            oracle.visible_users(VIEWER_WITHOUT_GROUPS, DEFAULT_VIEWER),
        ),
        # A NULL viewer: the default viewer's groups decide whether the list
        # applies, and the list of a NULL viewer is empty.
        "visible_users_null_viewer": (
            _job(lambda t: _visible(t, None)),
            oracle.visible_users(None, DEFAULT_VIEWER),
        ),
        "visible_users_null_viewer_unfiltered": (
            _job(lambda t: _visible(t, None, VIEWER_WITHOUT_GROUPS)),
            oracle.visible_users(None, VIEWER_WITHOUT_GROUPS),
        ),
        "detail_date_mismatch": (
            _job(lambda t: departments.detail_date_mismatch(t.detail, t.daily)),
            oracle.detail_date_mismatch(),
        ),
        # A start before 2016 becomes the first of the current month.
        "department_productivity_early_start": (
            _job(lambda t: _department(t, VIEWER_WITHOUT_GROUPS, EARLY_START, EARLY_AS_OF)),
            oracle.department_productivity(VIEWER_WITHOUT_GROUPS, DEFAULT_VIEWER, EARLY_START,
                                           DEPARTMENT_UNTIL, EARLY_AS_OF),
        ),
        "department_productivity": (
            _job(lambda t: _department(t, VIEWER_WITHOUT_GROUPS)),
            oracle.department_productivity(VIEWER_WITHOUT_GROUPS, DEFAULT_VIEWER, DEPARTMENT_FROM,
                                           DEPARTMENT_UNTIL, AS_OF),
        ),
        "department_productivity_viewer": (
            _job(lambda t: _department(t, VIEWER_WITH_GROUPS)),
            oracle.department_productivity(VIEWER_WITH_GROUPS, DEFAULT_VIEWER, DEPARTMENT_FROM,
                                           DEPARTMENT_UNTIL, AS_OF),
        ),
    }


# Step of the composed job, and the step of the oracle it must equal.
_STEP_KEYS = {
    "expire_duplicate_resources": ("expired", "a1"),
    "browser_activity_extract": ("snapshot", "a2"),
    "new_resource_candidates": ("candidates", "a3"),
    "register_resources": ("catalogue", "a4"),
    "reassign_activity": ("reassigned", "a5"),
    "affected_details": ("affected", "a6"),
    "detach_activity": ("activity", "a7"),
    "drop_details": ("detail", "a8"),
}


def _reclassify_jobs() -> dict[str, tuple[Job, str | None]]:
    jobs: dict[str, tuple[Job, str | None]] = {
        name: (_job(lambda t, s=step: getattr(reclassify_job.BrowserReclassify(t, AS_OF), s)),
               oracle.reclassify_step(sql_step, AS_OF))
        for name, (step, sql_step) in _STEP_KEYS.items()
    }
    jobs["browser_reclassify"] = (
        _job(lambda t: reclassify_job.summary(reclassify_job.browser_reclassify(t, AS_OF), AS_OF)),
        oracle.reclassify_summary(AS_OF),
    )
    # The next version's tables, out of the job as it is published.
    for table, sql_step in (("productivity_base", "a4"), ("user_activity", "a7"), ("user_productivity_daily_detail", "a8")):
        jobs[f"next_{table}"] = (
            _job(lambda t, name=table: reclassify_job.browser_reclassify(t, AS_OF).tables.as_dict()[name]),
            oracle.reclassify_step(sql_step, AS_OF),
        )
    return jobs


@functools.lru_cache(maxsize=8)
def _chain(spark: SparkSession, sf_dir: str) -> str:
    """Root of two published versions: the fixture tables, and what the browser
    re-attribution makes of them, of which only the days that change are written."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/chain-{uuid.uuid4().hex}"
    write_version(_tables(spark, sf_dir).as_dict(), root, "v0")
    reclassify_job.publish(reclassify_job.browser_reclassify(read_tables(spark, root), AS_OF), root, "v1", root)
    return root


def _published(table: str) -> Job:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read_tables(spark, _chain(spark, sf_dir)).as_dict()[table]
    return run


def _kept_sums(spark: SparkSession, sf_dir: str) -> tuple[Tables, DataFrame]:
    """The second version's tables and its day sums: those of the first version,
    with the days summed again whose detail files changed."""
    root = _chain(spark, sf_dir)
    store = day_sums.DaySums(spark, f"{root}/sums", MONTHLY)
    store.refresh(read_tables(spark, f"{root}/v0"))
    tables = read_tables(spark, f"{root}/v1")
    return tables, store.refresh(tables)


def _kept_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, sums = _kept_sums(spark, sf_dir)
    return user_report(tables, MONTHLY, sums)


def _kept_month_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, sums = _kept_sums(spark, sf_dir)
    return reports.month_totals(day_sums.user_day_totals(sums, tables.base), tables.users)


def _version_jobs() -> dict[str, tuple[Job, str | None]]:
    """Jobs over the version chain: tables read back from it, and reports from kept day sums."""
    jobs: dict[str, tuple[Job, str | None]] = {
        f"published_{table}": (_published(table), oracle.reclassify_step(step, AS_OF))
        for table, step in (("productivity_base", "a4"), ("user_activity", "a7"), ("user_productivity_daily_detail", "a8"))
    }
    jobs["kept_user_month_report"] = (_kept_report, oracle.after_reclassify(oracle.user_report(MONTHLY), AS_OF))
    jobs["kept_user_month_totals"] = (_kept_month_totals, oracle.after_reclassify(oracle.user_month_totals(), AS_OF))
    return jobs


def _binary_jobs() -> dict[str, tuple[Job, str | None]]:
    """Name comparison byte by byte: the lock screen pattern and the title ends then miss other spellings."""
    p = dataclasses.replace(MONTHLY, names=BINARY)
    with oracle.exact_names():
        return {
            "user_day_totals_binary": (
                _job(lambda t: rollup.user_day_totals(t.detail, t.base, BINARY)), oracle.user_day_totals()),
            "resource_hour_usage_binary": (
                _job(lambda t: reports.resource_hour_usage(t.detail, t.base, t.users, USAGE_AFTER, DOMAIN_PREFIX, names=BINARY)),
                oracle.resource_hour_usage(USAGE_AFTER, DOMAIN_PREFIX)),
            "user_month_report_binary": (_job(lambda t: user_report(t, p)), oracle.user_report(p)),
            "new_resource_candidates_binary": (
                _job(lambda t: reclassify_job.BrowserReclassify(t, AS_OF, names=BINARY).candidates),
                oracle.reclassify_step("a3", AS_OF)),
        }


JOBS = _jobs() | _version_jobs() | _binary_jobs()


def queries() -> dict[str, Job]:
    return {name: job for name, (job, _) in JOBS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in JOBS.items() if sql is not None}
