"""Roll-ups and reports on hand-made rows: one test per semantic rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens.operators import reports, rollup
from conftest import frame, rows, ts

LOCK_ID, WORD_ID, MAIL_ID, WORD2_ID = 3, 10, 11, 12


def _base(spark):
    return frame(spark, "productivity_base", [
        {"id": LOCK_ID, "resource_name": "Windows LockApp.exe"},
        {"id": WORD_ID, "resource_name": "Word"},
        {"id": MAIL_ID, "resource_name": "mail"},
        {"id": WORD2_ID, "resource_name": "WORD "},
        {"id": 13, "resource_name": None},
    ])


def _detail(spark, items):
    out = []
    for i, (day, hour, dur, ptype, user, res) in enumerate(items):
        start = ts(2024, 1, day, hour, 0, 0)
        out.append({
            "oid": i + 1, "date": ts(2024, 1, day), "hour_from": hour, "activity_start": start,
            "activity_end": start.replace(minute=30), "daily_duration": dur,
            "adjusted_productivity_type": ptype, "system_user": user, "productivity_base": res,
            "user_productivity_daily": user * 1000 + day,
        })
    return frame(spark, "user_productivity_daily_detail", out)


def test_day_totals_else_zero_and_null_type(spark):
    # Jan 8 2024 is a Monday.
    detail = _detail(spark, [
        (8, 9, 100, 1, 1, WORD_ID),
        (8, 10, 50, None, 1, WORD_ID),     # NULL type: total only (ELSE 0 buckets)
        (8, 11, 70, 0, 1, MAIL_ID),
        (8, 12, 999, 1, 1, LOCK_ID),       # lock screen excluded
        (8, 13, 5, 2, 1, 13),              # NULL name excluded, as NOT LIKE drops it
    ])
    r = rows(rollup.user_day_totals(detail, _base(spark)))
    assert len(r) == 1
    r = r[0]
    assert (r["sum_daily_duration"], r["sum_productive"], r["sum_distracting"], r["sum_undefined"]) == (220, 100, 0, 70)
    assert r["min_activity_start_seconds"] == 9 * 3600 and r["min_activity_start_time"] == "09:00:00"
    assert r["max_activity_end_time"] == "11:30:00"


def test_work_hours_conditional_matches_self_join(spark):
    # Monday 8th and Saturday 13th; weekdays 2..6 (Mon-Fri) for day work hours.
    items = [(8, 8, 10, 1, 1, WORD_ID), (8, 9, 20, None, 1, WORD_ID), (8, 19, 30, 3, 1, MAIL_ID),
             (8, 20, 40, 2, 1, MAIL_ID), (13, 10, 50, 1, 1, WORD_ID), (13, 11, 60, 2, 2, MAIL_ID)]
    detail, base = _detail(spark, items), _base(spark)
    got = rollup.user_day_work_hours(detail, base, ts(2024, 1, 1), ts(2024, 1, 31), (9, 19), (2, 6))
    by_day = {(r["date"].day, r["system_user"]): r for r in rows(got)}
    monday = by_day[(8, 1)]
    assert monday["sum_daily_duration"] == 100 and monday["sum_daily_duration_wh"] == 50
    assert monday["sum_undefined"] == 20 and monday["sum_undefined_wh"] == 20  # NULL type folds to Undefined
    assert monday["sum_distracting_wh"] is None                                # ELSE NULL
    assert monday["min_activity_start_time_wh"] == "09:00:00"
    saturday = by_day[(13, 1)]
    assert saturday["sum_daily_duration_wh"] is None and saturday["min_activity_start_seconds_wh"] is None

    # The original formulation: left self-join on the key restricted to work hours.
    d = detail.alias("up")
    wh = detail.alias("wh")
    cond = ((F.col("up.oid") == F.col("wh.oid")) & F.col("wh.hour_from").between(9, 19)
            & F.dayofweek("wh.date").between(2, 6))
    keep = base.where(~F.lower("resource_name").contains("lockapp")).select(F.col("id").alias("pb"))
    self_join = (d.join(keep, F.col("up.productivity_base") == F.col("pb")).join(wh, cond, "left")
                 .groupBy("up.date", "up.system_user")
                 .agg(F.sum("wh.daily_duration").alias("s"), F.min("wh.activity_start").alias("m")))
    expected = {(r["date"].day, r["system_user"]): (r["s"], r["m"]) for r in rows(self_join)}
    assert expected == {k: (v["sum_daily_duration_wh"], v["min_activity_start_wh"]) for k, v in by_day.items()}


def test_work_hour_sums_bounded_by_all_and_types_add_up(fixture_tables):
    t = fixture_tables
    days = rollup.user_day_work_hours(t.detail, t.base, ts(2024, 1, 1), ts(2024, 4, 30))
    parts = ["sum_productive", "sum_distracting", "sum_neutral", "sum_undefined"]
    for sfx in ("", "_wh"):
        total = sum(F.coalesce(F.col(p + sfx), F.lit(0)) for p in parts)
        assert days.where(F.col("sum_daily_duration" + sfx) != total).count() == 0
    assert days.where(F.col("sum_daily_duration_wh") > F.col("sum_daily_duration")).count() == 0


def test_month_total_over_a_day_wraps_and_keeps_seconds(spark):
    users = frame(spark, "system_user", [{"oid": 1, "name": "CORP/a"}])
    detail = _detail(spark, [(d, 10, 50000, 1, 1, WORD_ID) for d in (8, 9)])
    r = rows(reports.user_month_totals(detail, _base(spark), users))[0]
    assert r["sum_daily_duration_seconds"] == 100000 and r["sum_daily_duration"] == "03:46:40"
    assert r["year_month"] == "2024-01" and r["number_of_days_observed"] == 2


def test_usage_labels_and_name_merge(spark):
    users = frame(spark, "system_user", [{"oid": 1, "name": "CORP/anna"}, {"oid": 2, "name": "CORP/bo",
                                                                            "friendly_name": "Bo"}])
    detail = _detail(spark, [(8, 9, 10, 2, 1, WORD_ID), (8, 9, 5, 2, 1, WORD2_ID), (8, 9, 7, 9, 2, MAIL_ID),
                             (8, 9, 3, None, 2, MAIL_ID), (8, 9, 1, 1, 2, LOCK_ID)])
    got = rows(reports.resource_hour_usage(detail, _base(spark), users, ts(2023, 12, 31), "CORP/"),
               order=["system_user", "adjusted_productivity_type"])
    assert [(r["name"], r["resource_name"], r["duration"], r["productivity_type"]) for r in got] == [
        ("anna", "WORD ", 15, "UnProductive"),   # 'Word' and 'WORD ' merge; smallest spelling shown
        ("Bo", "mail", 7, "Undefined"),          # other type: own group, same label
        ("Bo", "mail", 3, "Undefined"),          # NULL type (sorted last)
    ]


def _sessions(spark, items):
    return frame(spark, "user_session", [
        {"system_user": u, "machine_name": m, "save_date": ts(2024, 1, d)} for u, m, d in items
    ])


def test_machine_list_skips_null_but_counts_it(spark):
    p = reports.monthly_params(sessions_since=ts(2024, 1, 1))
    s = _sessions(spark, [(1, "PC-2", 3), (1, "pc-2", 4), (1, "PC-10", 5), (1, None, 6),
                          (2, None, 3), (None, "PC-9", 3)])
    got = {r["system_user"]: r for r in rows(reports.user_machines(s, p))}
    assert set(got) == {1, 2}
    assert got[1]["computers_count"] == 3 and got[1]["computer_names"] == "PC-10[1]; PC-2[2]"
    assert got[2]["computers_count"] == 1 and got[2]["computer_names"] is None


def test_top_resources_ties_and_limit(spark):
    p = reports.period_params(as_of=ts(2024, 6, 1))
    rt = spark.createDataFrame(
        [(1, r, w, w) for r, w in [(20, 5), (21, 5), (22, 9), (23, 0), (24, 1), (25, 2), (26, 3), (27, 0)]],
        "system_user bigint, productivity_base bigint, work_duration bigint, all_duration bigint",
    )
    got = rows(reports.top_resources(rt, p), order=["rn_work_hours"])
    assert [r["productivity_base"] for r in got] == [22, 20, 21, 26, 25, 24]


def test_monthly_report_attaches_machines_through_pivot_row(spark):
    """A user-month without a top-resource row gets no machines (monthly);
    the period report attaches machines to the user directly."""
    base = _base(spark)
    users = frame(spark, "system_user", [{"oid": 1, "name": "CORP/a", "working_department": 7},
                                         {"oid": 2, "name": "CORP/b"}])
    dept = frame(spark, "department", [{"oid": 7, "name": "Sales"}])
    detail = _detail(spark, [(8, 10, 60, 1, 1, WORD_ID), (9, 10, 60, 1, 2, MAIL_ID)])
    sessions = _sessions(spark, [(1, "PC-1", 8), (2, "PC-2", 9)])
    p = reports.monthly_params(sessions_since=ts(2024, 1, 1), day_from=ts(2024, 1, 1), day_until=ts(2024, 1, 31))
    month = {r["user_name"]: r for r in rows(reports.user_report(detail, base, users, dept, sessions, p))}
    assert month["CORP/a"]["department"] == "Sales" and month["CORP/b"]["department"] == "-"
    assert month["CORP/a"]["computer_names"] == "PC-1[1]" and month["CORP/a"]["t1"] == "Word[0:01:00]"

    # With no ranks there is no top-resource row at all.
    p0 = reports.monthly_params(sessions_since=ts(2024, 1, 1), day_from=ts(2024, 1, 1),
                                day_until=ts(2024, 1, 31), top_k=0)
    month0 = {r["user_name"]: r for r in rows(reports.user_report(detail, base, users, dept, sessions, p0))}
    assert month0["CORP/a"]["computer_names"] is None and month0["CORP/a"]["computers_count"] is None

    q0 = reports.period_params(as_of=ts(2024, 6, 1), sessions_since=ts(2024, 1, 1), day_from=ts(2024, 1, 1),
                               top_k=0)
    period0 = {r["user_name"]: r for r in rows(reports.user_report(detail, base, users, dept, sessions, q0))}
    assert period0["CORP/a"]["computer_names"] == "PC-1[1]" and period0["CORP/a"]["computers_count"] == "1"
    assert period0["CORP/b"]["min_date"] == ts(2024, 1, 9)


def test_rollup_drift_and_pending(spark):
    detail = _detail(spark, [(8, 9, 100, 1, 1, WORD_ID), (8, 10, 10, 1, 1, WORD_ID), (8, 11, None, 1, 1, WORD_ID)])
    act = frame(spark, "user_activity", [
        {"id": 1, "active_duration": 60, "user_productivity_daily_detail": 1},
        {"id": 2, "active_duration": 43, "user_productivity_daily_detail": 1},   # 103 > 100 + 2
        {"id": 3, "active_duration": 12, "user_productivity_daily_detail": 2},   # 12 = 10 + 2: not reported
        {"id": 4, "active_duration": 50, "user_productivity_daily_detail": 3},   # NULL duration: never
        {"id": 5, "active_duration": 5, "object_type": 8, "inactivity_set": 1, "productivity_base": 1},
        {"id": 6, "active_duration": 0, "object_type": 8, "inactivity_set": 1, "productivity_base": 1},
    ])
    assert [(r["oid"], r["diff_duration"]) for r in rows(rollup.rollup_drift(detail, act))] == [(1, 3)]
    assert rows(rollup.pending_rollup_count(act)) == [{"pending_count": 1}]


def test_null_work_time_ranks_last(spark):
    p = reports.period_params(as_of=ts(2024, 6, 1))
    rt = spark.createDataFrame([(1, 30, None, None), (1, 31, 0, 0), (1, 32, 7, 7)],
                               "system_user bigint, productivity_base bigint, work_duration bigint, all_duration bigint")
    got = rows(reports.top_resources(rt, p), order=["rn_work_hours"])
    assert [r["productivity_base"] for r in got] == [32, 31, 30]
