"""The rule by which names compare, in every job that compares names."""

from __future__ import annotations

import pytest
from conftest import empty_tables, frame, rows, ts
from pyspark.sql import functions as F

from worklens.functions import BINARY, COLLATED, NOCASE, contains_name, key_in, left_of, name_key, site_name, without_prefix
from worklens.operators import access, departments, reports, rollup
from worklens.plans import reclassify as job

NOW = ts(2024, 6, 1)
RULES = {"nocase": NOCASE, "collated": COLLATED, "binary": BINARY}


def values(spark, names, expression):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    return [r.v for r in df.select("i", expression(F.col("n")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("rule", RULES.values(), ids=RULES)
def test_expressions(spark, rule):
    exact = rule is BINARY
    names = ["Chrome  ", "chrome", "CHROME", " chrome", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    groups = df.groupBy(name_key(F.col("n"), rule).alias("k")).agg(F.sort_array(F.collect_list("n")).alias("n")).select("n").collect()
    want = [["Chrome  "], ["chrome"], ["CHROME"], [" chrome"], []] if exact else [["CHROME", "Chrome  ", "chrome"], [" chrome"], []]
    assert sorted(r.n for r in groups) == sorted(want)
    assert values(spark, names, lambda c: key_in(c, ["chrome"], rule)) == ([False, True, False, False, None] if exact
                                                                           else [True, True, True, False, None])
    assert values(spark, ["a LockApp b", "lockapp", None], lambda c: contains_name(c, "lockapp", rule)) == [not exact, True, None]
    assert values(spark, ["x.PDF y", "x.pdf y", "x"], lambda c: left_of(c, ".pdf", rule)) == ["x.PDF y" if exact else "x", "x", "x"]
    assert values(spark, ["corp/U", "CORP/U", None], lambda c: without_prefix(c, "CORP/", rule)) == ["corp/U" if exact else "U", "U", None]
    assert values(spark, ["a./search", "a./Search"], lambda c: site_name(c, names=rule)) == ["a./search" if exact else "a", "a"]


@pytest.fixture(scope="module")
def tables(spark):
    base = [(1, "Google Chrome - chrome.exe"), (2, "google chrome - chrome.exe"), (3, "Editor"), (4, "editor "), (5, "Windows LockApp.exe"),
            (6, "lockapp"), (7, "EDITOR"), (8, None)]
    detail = [{"oid": i, "date": ts(2024, 1, 2 + i % 3), "hour_from": 10, "activity_start": ts(2024, 1, 2 + i % 3, 10),
               "activity_end": ts(2024, 1, 2 + i % 3, 11), "daily_duration": 10 + i, "adjusted_productivity_type": i % 4,
               "system_user": 1, "productivity_base": 1 + i % 8, "user_productivity_daily": 2 + i % 3} for i in range(40)]
    activity = [{"id": i, "first_captured_on": ts(2024, 1, 2), "description": ("Site.HTM x", "site.htm y", "SITE.htm", "Other")[i % 4],
                 "active_duration": 20, "productivity_base": 1 + i % 2} for i in range(16)]
    sessions = [{"system_user": 1, "machine_name": ("pc", "PC ", "Pc", "b", None)[i % 5], "save_date": ts(2024, 1, 3)} for i in range(25)]
    return empty_tables(
        spark,
        productivity_base=frame(spark, "productivity_base", [{"id": i, "resource_name": n, "browser_related": 1} for i, n in base]),
        user_productivity_daily_detail=frame(spark, "user_productivity_daily_detail", detail),
        user_productivity_daily=frame(spark, "user_productivity_daily", [{"oid": 2 + d, "date": ts(2024, 1, 2 + d)} for d in range(3)]),
        user_activity=frame(spark, "user_activity", activity), user_session=frame(spark, "user_session", sessions),
        system_user=frame(spark, "system_user", [{"oid": 1, "name": "corp/U", "comment": "p", "working_department": 1}]),
        department=frame(spark, "department", [{"oid": 1, "name": "D"}]))


def results(tables, rule):
    """What each job that compares names gives, as sorted rows."""
    t, p = tables, reports.monthly_params(sessions_since=ts(2024, 1, 1), day_from=ts(2024, 1, 1), day_until=ts(2024, 1, 31), names=rule)
    steps = job.BrowserReclassify(t, NOW, names=rule)
    kept = job.browser_reclassify(t, NOW, names=rule)
    visible = access.visible_users(t.users, t.system_user_to_group, t.filtering_group, t.app_user_to_group, -1, None)
    frames = {
        "expired": steps.expired, "snapshot": steps.snapshot, "candidates": steps.candidates, "catalogue": steps.catalogue,
        "reassigned": steps.reassigned, "activity": steps.activity, "kept": kept.activity,
        "day_totals": rollup.user_day_totals(t.detail, t.base, rule),
        "usage": reports.resource_hour_usage(t.detail, t.base, t.users, ts(2023, 12, 31), "CORP/", names=rule),
        "machines": reports.user_machines(t.user_session, p),
        "report": reports.user_report(t.detail, t.base, t.users, t.department, t.user_session, p),
        "department": departments.department_productivity(t.detail, t.daily, t.users, t.department, t.base, visible,
                                                          ts(2024, 1, 1), ts(2024, 2, 1), compare=rule),
    }
    return {name: sorted((tuple(r) for r in f.collect()), key=repr) for name, f in frames.items()}


def test_collated_names_equal_folded_keys_in_every_job(tables):
    assert results(tables, COLLATED) == results(tables, NOCASE)


def test_binary_names_in_every_job(spark, tables):
    nocase, exact = results(tables, NOCASE), results(tables, BINARY)
    assert {name for name in exact if exact[name] == nocase[name]} == set()
    assert len(exact["snapshot"]) == 8 and len(nocase["snapshot"]) == 16
    assert {(r[0], r[2], r[3]) for r in exact["candidates"]} == {("site", 80, 4), ("Other", 80, 4)}
    assert {(r[0], r[2], r[3]) for r in nocase["candidates"]} == {("SITE", 240, 12), ("Other", 80, 4)}
    assert exact["machines"] == [(1, 2024, 1, 5, "PC [5]; Pc[5]; b[5]; pc[5]")]
    assert nocase["machines"] == [(1, 2024, 1, 3, "b[5]; PC [15]")]
    lock = rows(tables.detail.where("productivity_base = 5").agg(F.sum("daily_duration").alias("s")))[0]["s"]
    totals = {n: sum(r[8] for r in got["day_totals"]) for n, got in (("exact", exact), ("nocase", nocase))}
    assert lock and len(exact["usage"]) > len(nocase["usage"]) and totals["exact"] != totals["nocase"]
