"""The version chain: days that change, two writers, proven facts, kept day sums."""

from __future__ import annotations

import os
import re
import tempfile

import pytest
from conftest import empty_tables, frame, rows, ts
from pyspark.sql import functions as F

from worklens.operators import access, departments, reports
from worklens.operators import reclassify as step
from worklens.plans import day_sums
from worklens.plans import reclassify as job
from worklens.plans.user_reports import user_report
from worklens.sources import versions
from worklens.sources.tables import read_tables, write_version

NOW = ts(2024, 6, 1)
DAYS = 90


def day(n, *hm):
    return ts(2024, 1 + n // 28, 1 + n % 28, *hm)


def browsing(spark, on_days, first=1):
    """Activity of DAYS days, of which only those on ``on_days`` lie on a browser entry with a site to move to."""
    activity = [{"id": n + 1, "first_captured_on": day(n, 9, 30), "description": f"site{n}.html", "active_duration": 60,
                 "productivity_base": 1 if n in on_days else 9, "user_productivity_daily_detail": 1000 + n,
                 "object_type": 8, "inactivity_set": 1} for n in range(DAYS)]
    activity.append({"id": 999, "first_captured_on": None, "description": "x", "active_duration": 1, "productivity_base": 9})
    detail = [{"oid": 1000 + n, "date": day(n), "hour_from": 9, "activity_start": day(n, 9), "activity_end": day(n, 10),
               "daily_duration": 60 + n, "adjusted_productivity_type": 1, "system_user": 5, "productivity_base": 9,
               "user_productivity_daily": 2000 + n} for n in range(DAYS)]
    daily = [{"oid": 2000 + n, "date": day(n)} for n in range(DAYS)]
    sessions = [{"system_user": 5, "machine_name": f"PC{n % 3}", "save_date": day(n, 8)} for n in range(DAYS)]
    base = [{"id": 1, "resource_name": "google chrome - chrome.exe"}, {"id": 9, "resource_name": "editor"}]
    return empty_tables(
        spark, user_activity=frame(spark, "user_activity", activity), productivity_base=frame(spark, "productivity_base", base),
        user_productivity_daily_detail=frame(spark, "user_productivity_daily_detail", detail),
        user_productivity_daily=frame(spark, "user_productivity_daily", daily),
        user_session=frame(spark, "user_session", sessions),
        department=frame(spark, "department", [{"oid": 3, "name": "D"}]),
        system_user=frame(spark, "system_user", [{"oid": 5, "name": "U", "working_department": 3}]))


def folders(root, version, table):
    path = os.path.join(root, version, table)
    return sorted(f for f in os.listdir(path) if "=" in f) if os.path.isdir(path) else []


def equal(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_only_days_that_change_are_written(spark):
    root = tempfile.mkdtemp(prefix="worklens-days-")
    write_version(browsing(spark, {3, 40}).as_dict(), root, "v0")
    first = read_tables(spark, root)
    result = job.browser_reclassify(first, NOW)
    job.publish(result, root, "v1", root)
    assert folders(root, "v1", "user_activity") == ["day=2024-01-04", "day=2024-02-13"]
    # the only detail row of each of the two days is dropped, so no partition of it is written
    assert folders(root, "v1", "user_productivity_daily_detail") == []
    second = read_tables(spark, root)
    for name, want in result.tables.as_dict().items():
        assert equal(second.as_dict()[name], want), name
    moved = {r["id"]: r["productivity_base"] for r in rows(second.activity) if r["productivity_base"] > 9}
    assert set(moved) == {4, 41}

    # A third version that changes nothing of either table writes none of their days, and reads the same.
    job.publish(job.browser_reclassify(second, ts(2024, 6, 2)), root, "v2", root)
    third = read_tables(spark, root)
    assert folders(root, "v2", "user_activity") == folders(root, "v2", "user_productivity_daily_detail") == []
    assert equal(third.activity, second.activity) and equal(third.detail, second.detail)
    # All earlier versions read as before.
    assert equal(read_tables(spark, f"{root}/v0").activity, first.activity)
    assert equal(read_tables(spark, f"{root}/v1").detail, second.detail)


def test_chain_of_day_rewrites_equals_full_rewrites(spark, fixture_tables):
    by_day, whole = (tempfile.mkdtemp(prefix=f"worklens-{n}-") for n in ("by-day", "whole"))
    write_version(fixture_tables.as_dict(), by_day, "v0")
    for n, now in enumerate((NOW, ts(2024, 6, 2)), 1):
        job.publish(job.browser_reclassify(read_tables(spark, by_day), now), by_day, f"v{n}", by_day)
    tables = fixture_tables
    for n, now in enumerate((NOW, ts(2024, 6, 2)), 1):
        write_version(job.browser_reclassify(tables, now).tables.as_dict(), whole, f"v{n}")
        tables = read_tables(spark, whole)
    for name, want in tables.as_dict().items():
        assert equal(read_tables(spark, by_day).as_dict()[name], want), name


def test_rows_without_a_timestamp_have_a_day_of_their_own(spark):
    root = tempfile.mkdtemp(prefix="worklens-null-")
    tables = browsing(spark, set())
    orphan = frame(spark, "user_activity", [{"id": 777, "description": "lost.html", "active_duration": 99, "productivity_base": 1}])
    write_version(tables.replace(user_activity=tables.activity.unionByName(orphan)).as_dict(), root, "v0")
    before = read_tables(spark, root)
    result = job.browser_reclassify(before, NOW)
    assert result.touched_days("user_activity") == [None]
    job.publish(result, root, "v1", root)
    assert folders(root, "v1", "user_activity") == ["day=__HIVE_DEFAULT_PARTITION__"]
    after = read_tables(spark, root).activity
    assert after.count() == before.activity.count()
    assert after.where("id = 777 and productivity_base > 9").count() == after.where("id = 999").count() == 1


def test_one_of_two_writers_from_one_parent_succeeds(spark):
    root = tempfile.mkdtemp(prefix="worklens-two-")
    write_version(browsing(spark, {3}).as_dict(), root, "v0")
    runs = [job.browser_reclassify(read_tables(spark, root), NOW) for _ in range(2)]
    job.publish(runs[0], root, "first", root)
    with pytest.raises(versions.StaleParent):
        job.publish(runs[1], root, "second", root)
    assert [v.name for v in versions.versions(spark, root)] == ["v0", "first"]
    assert versions.newest(spark, root).parent == "v0"
    # From the newest version the same changes can be made again.
    job.publish(job.browser_reclassify(read_tables(spark, root), NOW), root, "again", root)
    assert versions.newest(spark, root).name == "again"


def test_a_record_is_created_once_even_after_the_look(spark, monkeypatch):
    """Both writers have seen the parent as the newest before either creates its record."""
    root = tempfile.mkdtemp(prefix="worklens-race-")
    write_version(browsing(spark, {3}).as_dict(), root, "v0")
    parent = versions.newest(spark, root)
    versions.commit(spark, root, "first", parent, parent.tables, {})
    monkeypatch.setattr(versions, "newest", lambda *_: parent)
    with pytest.raises(versions.StaleParent):
        versions.commit(spark, root, "second", parent, parent.tables, {})
    monkeypatch.undo()
    assert [v.name for v in versions.versions(spark, root)] == ["v0", "first"]
    assert sorted(f for f in os.listdir(f"{root}/_log") if not f.startswith(".")) == [f"{n:020d}.json" for n in (0, 1)]


def test_a_file_is_created_once_by_many(spark):
    from concurrent.futures import ThreadPoolExecutor

    root = tempfile.mkdtemp(prefix="worklens-once-")

    def create(n):
        try:
            versions.create_once(spark, f"{root}/x", f"writer {n} " * 500)
            return n
        except FileExistsError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [n for n in pool.map(create, range(16)) if n is not None]
    assert len(won) == 1 and versions.read_text(spark, f"{root}/x") == f"writer {won[0]} " * 500


def test_sessions_and_activity_are_read_by_day(spark):
    root = tempfile.mkdtemp(prefix="worklens-prune-")
    write_version(browsing(spark, {3}).as_dict(), root, "v0")
    tables = read_tables(spark, root)
    p = reports.monthly_params(sessions_since=day(40, 8), day_from=day(45), day_until=day(50))
    for frame_, table in ((reports.user_machines(tables.between("user_session", p.sessions_since), p), "user_session"),
                          (tables.between("user_activity", day(3, 1), day(4, 2)), "user_activity")):
        text = frame_._jdf.queryExecution().sparkPlan().toString()
        scan = next(x for x in text.splitlines() if "FileScan" in x and f"/{table}]" in x)
        assert re.search(r"PartitionFilters: \[.*\(day#\d+ >= ", scan), scan
    assert equal(tables.between("user_session", day(40, 8), day(41, 8)),
                 tables.user_session.where(F.col("save_date").between(day(40, 8), day(41, 8))))
    plain = browsing(spark, {3})
    assert equal(plain.between("user_session", day(40, 8)), plain.user_session.where(F.col("save_date") >= F.lit(day(40, 8))))
    assert equal(reports.user_machines(tables.between("user_session", p.sessions_since), p),
                 reports.user_machines(tables.user_session, p))


def department(tables, first=day(10), last=day(20)):
    visible = access.visible_users(tables.users, tables.system_user_to_group, tables.filtering_group,
                                   tables.app_user_to_group, -1, None)
    return departments.department_productivity(tables.detail, tables.daily, tables.users, tables.department, tables.base,
                                               visible, first, last, tables.proves("dates_agree"))


def test_facts_are_proven_carried_over_and_used(spark):
    root = tempfile.mkdtemp(prefix="worklens-facts-")
    tables = browsing(spark, {3})
    write_version(tables.as_dict(), root, "v0")
    first = read_tables(spark, root)
    assert first.version.facts == {"unique_oid": True, "dates_agree": True}
    text = department(first)._jdf.queryExecution().sparkPlan().toString()
    scan = next(x for x in text.splitlines() if "FileScan" in x and "/user_productivity_daily_detail]" in x)
    assert re.search(r"PartitionFilters: \[.*\(date#\d+ >= ", scan)
    job.publish(job.browser_reclassify(first, NOW), root, "v1", root)
    assert read_tables(spark, root).version.facts == first.version.facts
    assert not job.browser_reclassify(first, NOW).tables.proves("dates_agree")

    # One detail row with a date that is not its parent's, and one oid twice: nothing is assumed, and nothing lost.
    odd = frame(spark, "user_productivity_daily_detail", [
        {"oid": 1001, "date": day(60), "daily_duration": 7, "adjusted_productivity_type": 1, "system_user": 5,
         "productivity_base": 9, "user_productivity_daily": 2015}])
    other = tempfile.mkdtemp(prefix="worklens-odd-")
    write_version(tables.replace(user_productivity_daily_detail=tables.detail.unionByName(odd)).as_dict(), other, "v0")
    second = read_tables(spark, other)
    assert second.version.facts == {"unique_oid": False, "dates_agree": False}
    assert rows(department(second))[0]["sum_daily"] == rows(department(first))[0]["sum_daily"] + 7


def test_kept_sums_read_only_the_days_that_changed(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="worklens-sums-")
    write_version(browsing(spark, {30}).as_dict(), root, "v0")
    p = reports.monthly_params(sessions_since=day(0), day_from=day(0), day_until=day(89))
    store = day_sums.DaySums(spark, f"{root}/sums", p)
    first = read_tables(spark, root)
    assert len(store.stale_days(first)) == DAYS
    assert equal(user_report(first, p, store.refresh(first)), user_report(first, p))
    assert store.stale_days(first) == []

    # One day changes: another duration on day 30, whose partition alone is replaced.
    changed = first.on_days("user_productivity_daily_detail", [day(30).date()]).withColumn("daily_duration", F.lit(5000))
    write_version({"user_productivity_daily_detail": changed}, root, "v1", first.version.tables, first.version,
                  {"user_productivity_daily_detail": [day(30).date()]})
    second = read_tables(spark, root)
    assert store.stale_days(second) == [f"{day(30):%Y-%m-%d}"]
    seen = []
    write = day_sums.write_table
    monkeypatch.setattr(day_sums, "write_table", lambda f, *a: seen.append(f) or write(f, *a))
    sums = store.refresh(second)
    assert len(seen) == 1 and seen[0].count() == 1
    text = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert "PartitionFilters: [" in text and "2024-02-03" in text
    report = user_report(second, p, sums)
    assert not [x for x in report._jdf.queryExecution().sparkPlan().toString().splitlines()
                if "FileScan" in x and "/user_productivity_daily_detail" in x]
    assert equal(report, user_report(second, p)) and not equal(report, user_report(first, p))

    # The first version's sums are still there.
    assert store.stale_days(first) == []
    assert equal(user_report(first, p, store.refresh(first)), user_report(first, p))
    # A day that loses all rows, and a run that only reads.
    job.publish(job.browser_reclassify(second, NOW), root, "v2", root)
    third = read_tables(spark, root)
    assert store.stale_days(third) == []
    assert equal(user_report(third, p, store.refresh(third)), user_report(third, p))


def test_kept_totals_equal_the_full_run(spark, fixture_tables):
    from worklens.operators import rollup

    root = tempfile.mkdtemp(prefix="worklens-totals-")
    write_version(fixture_tables.as_dict(), root, "v0")
    tables = read_tables(spark, root)
    p = reports.monthly_params(sessions_since=ts(2024, 1, 1), day_from=ts(2024, 1, 10), day_until=ts(2024, 3, 20))
    sums = day_sums.DaySums(spark, f"{root}/sums", p).refresh(tables)
    assert equal(day_sums.user_day_totals(sums, tables.base), rollup.user_day_totals(tables.detail, tables.base))
    assert equal(day_sums.user_day_work_hours(sums, tables.base, p),
                 rollup.user_day_work_hours(tables.detail, tables.base, p.day_from, p.day_until, p.work_hours, p.day_weekdays))


def test_two_runs_refresh_one_store(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="worklens-both-")
    write_version(browsing(spark, set()).as_dict(), root, "v0")
    tables = read_tables(spark, root)
    p = reports.monthly_params(sessions_since=day(0), day_from=day(0), day_until=day(89))
    one, two = (day_sums.DaySums(spark, f"{root}/sums", p) for _ in range(2))
    write, raced = day_sums.write_table, []

    def write_while_another_publishes(*args):
        write(*args)
        if not raced:
            raced.append(1)
            two.refresh(tables)

    monkeypatch.setattr(day_sums, "write_table", write_while_another_publishes)
    assert equal(user_report(tables, p, one.refresh(tables)), user_report(tables, p))


def test_a_table_that_is_not_laid_out_by_day_is_written_whole(spark):
    root = tempfile.mkdtemp(prefix="worklens-flat-")
    tables = browsing(spark, {3})
    for name, rows_ in tables.as_dict().items():
        rows_.write.parquet(f"{root}/plain/{name}")
    plain = read_tables(spark, f"{root}/plain")
    assert plain.version is None and not plain.by_day
    result = job.browser_reclassify(plain, NOW)
    job.publish(result, f"{root}/chain", "v1", f"{root}/plain")
    after = read_tables(spark, f"{root}/chain")
    assert equal(after.activity, result.activity) and set(after.by_day) == {"user_activity", "user_productivity_daily_detail"}
    with pytest.raises(ValueError, match="laid out by day"):
        write_version({"user_session": plain.user_session}, f"{root}/chain", "v2", after.version.tables, after.version,
                      {"user_session": [day(3).date()]})


def test_days_of_changes(spark):
    changed = frame(spark, "user_activity", [{"id": 1, "first_captured_on": day(3, 5)}, {"id": 2, "first_captured_on": day(3, 6)},
                                             {"id": 3}])
    assert {r["day"] for r in step.days_of("user_activity", changed).collect()} == {day(3).date(), None}
