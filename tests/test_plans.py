"""Physical-plan shape: the rewrites the jobs rely on actually happen.

The tables are written to parquet first, so scans, pushed filters and read
schemas are those of real table reads.
"""

from __future__ import annotations

import re
import tempfile

import pytest

from worklens.operators import access, departments, reports, rollup
from worklens.sources.tables import read_tables, write_version
from conftest import ts

P = reports.monthly_params(sessions_since=ts(2024, 1, 1), day_from=ts(2024, 1, 1), day_until=ts(2024, 4, 30))


@pytest.fixture(scope="module")
def tables(spark, fixture_tables):
    root = tempfile.mkdtemp(prefix="worklens-plans-")
    write_version(fixture_tables.as_dict(), root, "v0")
    return read_tables(spark, f"{root}/v0")


def plan(df) -> str:
    """The physical plan Spark chose for ``df`` before adaptive execution
    (join strategies, scans with their static partition and pushed filters;
    runtime pruning subqueries and shuffle stages are added after this)."""
    return df._jdf.queryExecution().sparkPlan().toString()


def scans(text: str, table: str) -> list[str]:
    return [line for line in text.splitlines() if "FileScan parquet" in line and f"/{table}]" in line]


def test_work_hours_is_one_scan_without_self_join(tables):
    text = plan(rollup.user_day_work_hours(tables.detail, tables.base, P.day_from, P.day_until))
    detail_scans = scans(text, "user_productivity_daily_detail")
    assert len(detail_scans) == 1
    assert "SortMergeJoin" not in text
    # the day bound prunes day partitions of the table; unused columns are not read
    assert re.search(r"PartitionFilters: \[.*\(date#\d+ >= .*\(date#\d+ <= ", detail_scans[0])
    assert "user_productivity_daily:" not in detail_scans[0].split("ReadSchema")[1]


def test_top_resources_use_window_group_limit(tables):
    text = plan(reports.top_resources(reports.user_resource_time(tables.detail, tables.base, P), P))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_pivot_scans_detail_once(tables):
    top = reports.top_resources(reports.user_resource_time(tables.detail, tables.base, P), P)
    text = plan(reports.top_resources_pivot(top, tables.base, P))
    assert len(scans(text, "user_productivity_daily_detail")) == 1


def test_catalogue_and_dimensions_are_broadcast(tables):
    text = plan(reports.user_report(tables.detail, tables.base, tables.users, tables.department,
                                    tables.user_session, P))
    assert "BroadcastHashJoin" in text
    # the detail table was read when its sums were written; each half reads the sums
    assert not scans(text, "user_productivity_daily_detail")
    assert len(scans(text, "system_user")) == 1


def test_department_window_pushed_to_parent_day_scan(tables):
    visible = access.visible_users(tables.users, tables.system_user_to_group, tables.filtering_group,
                                   tables.app_user_to_group, -1, 0)
    text = plan(departments.department_productivity(
        tables.detail, tables.daily, tables.users, tables.department, tables.base, visible,
        ts(2024, 1, 1), ts(2024, 3, 1)))
    daily_scan = scans(text, "user_productivity_daily")
    assert daily_scan and re.search(r"PartitionFilters: \[.*\(date#\d+ >= ", daily_scan[0])
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_usage_filter_pushed(tables):
    text = plan(reports.resource_hour_usage(tables.detail, tables.base, tables.users, ts(2024, 2, 1), "CORP/"))
    assert re.search(r"PartitionFilters: \[.*\(date#\d+ > ", scans(text, "user_productivity_daily_detail")[0])


def test_monthly_report_reads_detail_once_and_only_the_report_months(tables, monkeypatch):
    p = reports.monthly_params(sessions_since=ts(2024, 1, 1), day_from=ts(2024, 2, 10), day_until=ts(2024, 3, 5))
    seen = []
    monkeypatch.setattr(reports, "materialize", lambda df, name: seen.append(plan(df)) or df)
    reports.user_report(tables.detail, tables.base, tables.users, tables.department, tables.user_session, p)
    assert len(seen) == 1
    detail_scans = scans(seen[0], "user_productivity_daily_detail")
    assert len(detail_scans) == 1
    assert "PartitionFilters: [isnotnull(date" in detail_scans[0] and "2024-04-01" in detail_scans[0]


def _exchanges_of_detail_rows(spark, build) -> list[str]:
    """Shuffles whose input is the detail scan without an aggregate in between,
    when nothing may be broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        lines = build()._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k in keys:
            spark.conf.unset(k)
    found = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = []
            for next_line in lines[i + 1:]:
                if "Exchange" in next_line or "Join" in next_line or "Scan" in next_line:
                    below.append(next_line)
                    break
                below.append(next_line)
            if "user_productivity_daily_detail]" in below[-1] and not any("Aggregate" in x for x in below):
                found.append(line)
    return found


@pytest.mark.parametrize("job", ["user_day_totals", "user_day_work_hours", "user_resource_time", "department"])
def test_no_detail_row_is_shuffled_before_it_is_summed(spark, tables, job):
    visible = access.visible_users(tables.users, tables.system_user_to_group, tables.filtering_group,
                                   tables.app_user_to_group, -1, 0)
    build = {
        "user_day_totals": lambda: rollup.user_day_totals(tables.detail, tables.base),
        "user_day_work_hours": lambda: rollup.user_day_work_hours(tables.detail, tables.base, P.day_from, P.day_until),
        "user_resource_time": lambda: reports.user_resource_time(tables.detail, tables.base, P),
        "department": lambda: departments.department_productivity(
            tables.detail, tables.daily, tables.users, tables.department, tables.base, visible,
            ts(2024, 1, 1), ts(2024, 3, 1)),
    }[job]
    assert _exchanges_of_detail_rows(spark, build) == []


def test_department_detail_scan_is_bounded_where_dates_agree(tables):
    visible = access.visible_users(tables.users, tables.system_user_to_group, tables.filtering_group,
                                   tables.app_user_to_group, -1, 0)
    text = plan(departments.department_productivity(
        tables.detail, tables.daily, tables.users, tables.department, tables.base, visible,
        ts(2024, 1, 1), ts(2024, 3, 1), dates_agree=True))
    assert re.search(r"PartitionFilters: \[.*\(date#\d+ >= ", scans(text, "user_productivity_daily_detail")[0])


def test_reassignment_does_not_join_activity_by_id(tables):
    from worklens.operators import reclassify as step

    base1 = step.expire_duplicate_resources(tables.base, ts(2024, 6, 1))
    snap = step.browser_activity_extract(tables.activity, base1, tables.detail)
    base2 = step.register_resources(base1, step.new_resource_candidates(snap, base1), ts(2024, 6, 1))
    text = plan(step.detach_activity(step.reassign_activity(tables.activity, base1, base2),
                                     step.affected_details(snap)))
    activity_ids = set()
    for line in scans(text, "user_activity"):
        activity_ids.update(re.findall(r"\bid#\d+L?", line.split("]")[0]))
    assert activity_ids
    join_lines = [line for line in text.splitlines() if re.search(r"(HashJoin|MergeJoin) \[", line)]
    assert not [line for line in join_lines for a in activity_ids if f"[{a}]" in line or f"[{a}," in line]
