"""Visibility, report window and the department report."""

from __future__ import annotations

from worklens.operators import access, departments
from conftest import frame, rows, ts

EXPIRED = ts(2023, 6, 1)


def _visibility(spark):
    users = frame(spark, "system_user", [
        {"oid": 1, "name": "CORP/a", "comment": "Dev", "working_department": 7},
        {"oid": 2, "name": "corp/A", "comment": "dev", "working_department": 7},
        {"oid": 3, "name": "CORP/c", "working_department": 8},
        {"oid": 4, "name": "CORP/d", "expired_on": EXPIRED, "working_department": 7},
        {"oid": 5, "name": "CORP/e"},
    ])
    groups = frame(spark, "filtering_group", [
        {"id": 100, "user_inclusion_type": 0}, {"id": 101, "user_inclusion_type": 1},
        {"id": 102, "user_inclusion_type": 0, "expired_on": EXPIRED},
    ])
    user_groups = frame(spark, "system_user_to_group", [
        {"system_user": 1, "filtering_group": 100}, {"system_user": 4, "filtering_group": 100},
        {"system_user": 2, "filtering_group": 101}, {"system_user": 3, "filtering_group": 102},
        {"system_user": 3, "filtering_group": 100, "expired_on": EXPIRED},
        {"system_user": 1, "filtering_group": 100},
    ])
    viewer_groups = frame(spark, "app_user_to_group", [
        {"app_user": 50, "filtering_group": 100},      # usable
        {"app_user": 51, "filtering_group": 101},      # wrong inclusion type
        {"app_user": 52, "filtering_group": 102},      # expired group
        {"app_user": 53, "filtering_group": 100, "expired_on": EXPIRED},
    ])
    return users, user_groups, groups, viewer_groups


def _visible(spark, viewer, default):
    users, ug, g, vg = _visibility(spark)
    return sorted(r["system_user"] for r in rows(access.visible_users(users, ug, g, vg, viewer, default)))


def test_viewer_with_groups_sees_active_members_once(spark):
    assert _visible(spark, 50, 99) == [1]


def test_viewer_without_usable_groups_sees_every_active_user(spark):
    for viewer in (51, 52, 53, 999):
        assert _visible(spark, viewer, 50) == [1, 2, 3, 5]


def test_null_viewer_uses_default_for_the_test_but_not_for_the_list(spark):
    assert _visible(spark, None, 50) == []            # default has groups, raw viewer lists nobody
    assert _visible(spark, None, 51) == [1, 2, 3, 5]  # default has none: everyone


def test_report_window():
    now = ts(2024, 12, 15)
    assert access.report_window(access.EARLIEST_FROM, access.LATEST_UNTIL, now) == (ts(2016, 1, 1), ts(2020, 1, 1))
    assert access.report_window(ts(2015, 5, 1), ts(2021, 1, 1), now) == (ts(2024, 12, 1), ts(2025, 1, 1))
    assert access.report_window(ts(2017, 1, 1), ts(2018, 1, 1), now) == (ts(2017, 1, 1), ts(2018, 1, 1))


def test_department_report(spark):
    users, ug, g, vg = _visibility(spark)
    dept = frame(spark, "department", [{"oid": 7, "name": "Sales"}, {"oid": 8, "name": "sales "}])
    base = frame(spark, "productivity_base", [{"id": 10, "resource_name": "Word"},
                                              {"id": 3, "resource_name": "LockApp.exe"}])
    daily = frame(spark, "user_productivity_daily", [
        {"oid": 1, "date": ts(2024, 1, 1)}, {"oid": 2, "date": ts(2024, 2, 1)}, {"oid": 3, "date": ts(2024, 2, 2)},
    ])
    detail = frame(spark, "user_productivity_daily_detail", [
        {"oid": 1, "system_user": 1, "productivity_base": 10, "daily_duration": 10,
         "adjusted_productivity_type": 1, "user_productivity_daily": 1},
        {"oid": 2, "system_user": 2, "productivity_base": 10, "daily_duration": 20,
         "adjusted_productivity_type": 1, "user_productivity_daily": 2},          # homonym of user 1
        {"oid": 3, "system_user": 1, "productivity_base": 10, "daily_duration": 5,
         "adjusted_productivity_type": 7, "user_productivity_daily": 2},          # other type: NULL label
        {"oid": 4, "system_user": 1, "productivity_base": 3, "daily_duration": 4,
         "adjusted_productivity_type": 0, "user_productivity_daily": 1},          # lock screen kept
        {"oid": 5, "system_user": 1, "productivity_base": 10, "daily_duration": 100,
         "adjusted_productivity_type": 1, "user_productivity_daily": 3},          # after the window
        {"oid": 6, "system_user": 5, "productivity_base": 10, "daily_duration": 100,
         "adjusted_productivity_type": 1, "user_productivity_daily": 1},          # no department
    ])
    everyone = access.visible_users(users, ug, g, vg, 999, 999)
    got = rows(departments.department_productivity(detail, daily, users, dept, base, everyone,
                                                   ts(2024, 1, 1), ts(2024, 2, 1)),
               order=["resource_name", "adjusted_productivity_type"])
    assert [(r["department_name"], r["username"], r["resource_name"], r["adjusted_productivity_type"],
             r["sum_productive"], r["sum_undefined"], r["sum_daily"]) for r in got] == [
        ("Sales", "CORP/a", "LockApp.exe", "Undefined", 0, 4, 4),
        ("Sales", "CORP/a", "Word", "Productive", 30, 0, 30),
        ("Sales", "CORP/a", "Word", None, 0, 0, 5),
    ]
    only_one = access.visible_users(users, ug, g, vg, 50, 50)
    got = rows(departments.department_productivity(detail, daily, users, dept, base, only_one,
                                                   ts(2024, 1, 1), ts(2024, 2, 1)))
    assert sorted(r["sum_daily"] for r in got) == [4, 5, 10]


def test_detail_date_mismatch(spark):
    daily = frame(spark, "user_productivity_daily", [{"oid": 1, "date": ts(2024, 1, 1)}, {"oid": 2}])
    detail = frame(spark, "user_productivity_daily_detail", [
        {"oid": 1, "date": ts(2024, 1, 1), "user_productivity_daily": 1},
        {"oid": 2, "date": ts(2024, 1, 2), "user_productivity_daily": 1},
        {"oid": 3, "date": ts(2024, 1, 1), "user_productivity_daily": 2},
        {"oid": 4, "date": ts(2024, 1, 1), "user_productivity_daily": 9}, {"oid": 5}])
    got = rows(departments.detail_date_mismatch(detail, daily))
    assert sorted((r["user_productivity_daily"] or 0, r["detail_rows"]) for r in got) == [(0, 1), (1, 1), (2, 1), (9, 1)]
