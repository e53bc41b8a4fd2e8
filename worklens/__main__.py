"""Run one job over a table version and write its result.

    spark-submit --py-files worklens.zip -m worklens user_month_report \\
        --tables /data/activity/v42 --out /data/reports/2018-12 --as-of 2018-12-31 ...

``--tables`` is a published version, a folder of versions (the newest counts),
or holds the ten tables as ``<root>/<table>`` parquet (see
``worklens.sources.tables``). Parameters default to the original jobs' values;
``--day-from``, ``--day-until``, ``--sessions-since``, ``--after``,
``--viewer``, ``--default-viewer`` and ``--domain-prefix`` override them.
``--sums`` names a folder of kept day sums (``worklens.plans.day_sums``): the
per-user reports and totals then read only the days of detail that changed
since the sums were last refreshed. What is proven of the version (see
``worklens.sources.versions``) bounds the department report's scan by date.
``browser_reclassify`` publishes the next version as ``--out/<--version>``,
which must not exist; no other job overwrites its output either.
"""

from __future__ import annotations

import argparse
import datetime as _dt
import sys

from pyspark.sql import SparkSession

from worklens.functions.names import RULES
from worklens.operators import access, departments, reports, rollup
from worklens.plans import day_sums
from worklens.plans import reclassify as reclassify_job
from worklens.plans.user_reports import user_report
from worklens.session import configure
from worklens.sources.tables import read_tables


def _date(text: str) -> _dt.datetime:
    return _dt.datetime.fromisoformat(text)


def _report_params(args, monthly: bool) -> reports.ReportParams:
    overrides = {k: v for k, v in {
        "names": args.names, "day_from": args.day_from, "day_until": args.day_until, "sessions_since": args.sessions_since,
    }.items() if v is not None}
    if monthly:
        return reports.monthly_params(**overrides)
    return reports.period_params(as_of=args.as_of, **overrides)


def _jobs(args):
    def visible(t):
        return access.visible_users(t.users, t.system_user_to_group, t.filtering_group, t.app_user_to_group,
                                    args.viewer, args.default_viewer)

    def department(t):
        date_from, date_until = access.report_window(
            args.day_from or access.EARLIEST_FROM, args.day_until or access.LATEST_UNTIL, args.as_of)
        return departments.department_productivity(t.detail, t.daily, t.users, t.department, t.base,
                                                   visible(t), date_from, date_until, t.proves("dates_agree"), args.names)

    def kept(t, params):
        return day_sums.DaySums(t.base.sparkSession, args.sums, params).refresh(t) if args.sums else None

    def report(monthly):
        params = _report_params(args, monthly)
        return lambda t: user_report(t, params, kept(t, params))

    def day_totals(t):
        sums = kept(t, _report_params(args, True))
        return (rollup.user_day_totals(t.detail, t.base, args.names) if sums is None
                else day_sums.user_day_totals(sums, t.base, args.names))

    return {
        "pending_rollup_count": lambda t: rollup.pending_rollup_count(t.activity),
        "rollup_drift": lambda t: rollup.rollup_drift(t.detail, t.activity, args.tolerance),
        "user_day_totals": day_totals,
        "user_month_totals": lambda t: reports.month_totals(day_totals(t), t.users),
        "resource_hour_usage": lambda t: reports.resource_hour_usage(
            t.detail, t.base, t.users, args.after, args.domain_prefix, args.limit, args.names),
        "user_month_report": report(True),
        "user_period_report": report(False),
        "visible_users": visible,
        "department_productivity": department,
    }


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="worklens")
    parser.add_argument("job", help="job name, or browser_reclassify")
    parser.add_argument("--tables", required=True, help="root of the current table version")
    parser.add_argument("--out", required=True, help="output path (a new version root for browser_reclassify)")
    parser.add_argument("--version", default=None, help="version name written by browser_reclassify")
    parser.add_argument("--as-of", type=_date, required=True, help="'now' of the job")
    parser.add_argument("--day-from", type=_date)
    parser.add_argument("--day-until", type=_date)
    parser.add_argument("--sessions-since", type=_date)
    parser.add_argument("--after", type=_date, default=_dt.datetime(2018, 10, 1))
    parser.add_argument("--viewer", type=int, default=None)
    parser.add_argument("--default-viewer", type=int, default=None)
    parser.add_argument("--domain-prefix", default="")
    parser.add_argument("--sums", help="folder of kept day sums, made or refreshed by this run")
    parser.add_argument("--limit", type=int, default=None)
    parser.add_argument("--tolerance", type=int, default=2)
    parser.add_argument("--collation", choices=[r.collation for r in RULES], default=RULES[0].collation,
                        help="how names compare")
    args = parser.parse_args(argv)
    args.names = next(r for r in RULES if r.collation == args.collation)

    spark = configure(SparkSession.builder.appName(f"worklens-{args.job}").getOrCreate())
    tables = read_tables(spark, args.tables)
    if args.job == "browser_reclassify":
        result = reclassify_job.browser_reclassify(tables, args.as_of, names=args.names)
        reclassify_job.publish(result, args.out, args.version or args.as_of.strftime("v%Y%m%d%H%M%S"), args.tables)
        return 0
    if tables.version and not tables.proves("unique_oid"):
        print("warning: detail rows share oids; work-hour sums count each of them once", file=sys.stderr)
    jobs = _jobs(args)
    if args.job not in jobs:
        parser.error(f"unknown job {args.job!r}; one of {sorted(jobs) + ['browser_reclassify']}")
    jobs[args.job](tables).write.parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
