"""Browser re-attribution steps and the composed job."""

from __future__ import annotations

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from worklens.operators import reclassify as step
from worklens.plans import reclassify as job
from worklens.plans.distributed import global_ordinal, join_spreading_key, left_join_spreading_nulls, materialize
from worklens.sources.tables import published_versions, read_tables, write_version
from conftest import empty_tables, frame, rows, ts

NOW = ts(2024, 6, 1)
CHROME, FIREFOX = 0, 1


def test_expire_only_the_newest_duplicate_per_run(spark):
    base = frame(spark, "productivity_base", [
        {"id": 1, "resource_name": "site"}, {"id": 2, "resource_name": "SITE "}, {"id": 3, "resource_name": "site"},
        {"id": 4, "resource_name": "  "}, {"id": 5, "resource_name": "  "}, {"id": 6}, {"id": 7},
        {"id": 8, "resource_name": "old", "expired_on": ts(2020, 1, 1)}, {"id": 9, "resource_name": "old"},
    ])
    once = step.expire_duplicate_resources(base, NOW)
    assert [r["id"] for r in rows(once.where(F.col("expired_on") == NOW))] == [3]
    twice = step.expire_duplicate_resources(once, ts(2024, 6, 2))
    assert [r["id"] for r in rows(twice.where(F.col("expired_on") == ts(2024, 6, 2)))] == [2]
    assert twice.count() == base.count()


def _scenario(spark):
    base = frame(spark, "productivity_base", [
        {"id": CHROME, "resource_name": "google chrome - chrome.exe", "browser_related": 1},
        {"id": FIREFOX, "resource_name": "firefox - firefox.exe", "browser_related": 1},
        {"id": 2, "resource_name": "known site", "browser_related": 1},
        {"id": 3, "resource_name": "Known Site", "browser_related": 1},
        {"id": 4, "resource_name": "word", "browser_related": 0},
    ])
    detail = frame(spark, "user_productivity_daily_detail", [{"oid": o, "daily_duration": 60} for o in (100, 101, 102)])
    activity = frame(spark, "user_activity", [
        {"id": 1, "description": "news.com/today", "active_duration": 20, "productivity_base": CHROME,
         "user_productivity_daily_detail": 100},
        {"id": 2, "description": "News.com/other", "active_duration": 15, "productivity_base": CHROME,
         "user_productivity_daily_detail": 101},
        {"id": 3, "description": "news.com/x", "active_duration": 40, "productivity_base": FIREFOX},
        {"id": 4, "description": "Known Site.htm", "active_duration": 5, "productivity_base": FIREFOX,
         "user_productivity_daily_detail": 999},                 # dangling link: upd_oid NULL
        {"id": 5, "description": "rare.pdf", "active_duration": 10, "productivity_base": CHROME,
         "user_productivity_daily_detail": 102},
        {"id": 6, "description": "   ", "active_duration": 50, "productivity_base": CHROME},
        {"id": 7, "description": "idle.com/", "active_duration": 0, "productivity_base": CHROME},
        {"id": 8, "description": "doc", "active_duration": 50, "productivity_base": 4,
         "user_productivity_daily_detail": 101},                 # not browser, shares detail 101
    ])
    return empty_tables(spark, productivity_base=base, user_productivity_daily_detail=detail,
                        user_activity=activity)


def test_steps_on_a_small_catalogue(spark):
    t = _scenario(spark)
    snap = step.browser_activity_extract(t.activity, t.base, t.detail)
    assert sorted((r["id"], r["new_resource_name"], r["upd_oid"]) for r in rows(snap)) == [
        (1, "news", 100), (2, "News", 101), (3, "news", None), (4, "Known Site", None), (5, "rare", 102),
    ]
    cands = rows(step.new_resource_candidates(snap, t.base), order=["existing_resource_name"])
    # 'news' passes in both browsers (35 s and 40 s): listed twice; 'rare' (10 s) and the known site do not.
    assert [(r["new_resource_name"], r["existing_resource_name"], r["sum_active_duration"]) for r in cands] == [
        ("news", "firefox - firefox.exe", 40),
        ("News", "google chrome - chrome.exe", 35),   # spellings merge; the smallest is kept
    ]
    base2 = step.register_resources(t.base, step.new_resource_candidates(snap, t.base), NOW)
    added = rows(base2.where(F.col("id") > 4), order=["id"])
    assert [r["id"] for r in added] == [5, 6]
    assert {r["resource_name"].lower() for r in added} == {"news"}
    assert all(r["browser_related"] == 1 and r["created_on"] == NOW for r in added)

    moved = {r["id"]: r for r in rows(step.reassign_activity(t.activity, t.base, base2))}
    assert moved[1]["productivity_base"] == 5 and moved[1]["user_productivity_daily_detail"] is None
    assert moved[3]["productivity_base"] == 5
    assert moved[4]["productivity_base"] == 2                   # lowest id among 'known site' spellings
    assert moved[5]["productivity_base"] == CHROME and moved[5]["user_productivity_daily_detail"] == 102
    assert moved[8]["user_productivity_daily_detail"] == 101

    affected = step.affected_details(snap)
    assert sorted(rows(affected), key=lambda r: (r["upd_oid"] is None, r["upd_oid"])) == [
        {"upd_oid": 100}, {"upd_oid": 101}, {"upd_oid": 102}, {"upd_oid": None}]
    detached = {r["id"]: r for r in rows(step.detach_activity(step.reassign_activity(t.activity, t.base, base2),
                                                               affected))}
    assert detached[8]["user_productivity_daily_detail"] is None   # shares an affected detail
    assert detached[4]["user_productivity_daily_detail"] is None   # moved
    assert [r["oid"] for r in rows(step.drop_details(t.detail, affected))] == []


def test_drop_details_with_null_in_the_set_keeps_unmatched(spark):
    detail = frame(spark, "user_productivity_daily_detail", [{"oid": 1}, {"oid": 2}])
    affected = spark.createDataFrame([(1,), (None,)], "upd_oid bigint")
    assert [r["oid"] for r in rows(step.drop_details(detail, affected))] == [2]


def test_detach_is_idempotent(fixture_tables):
    t = fixture_tables
    affected = step.affected_details(step.browser_activity_extract(t.activity, t.base, t.detail))
    once = step.detach_activity(t.activity, affected)
    twice = step.detach_activity(once, affected)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_composed_job_removes_affected_rows_and_every_link_to_them(spark, fixture_tables):
    result = job.browser_reclassify(fixture_tables, NOW)
    t = result.tables
    affected = {r["upd_oid"] for r in result.affected.collect()} - {None}
    details = {r["oid"] for r in fixture_tables.detail.collect()}
    assert affected and {r["oid"] for r in t.detail.collect()} == details - affected
    before = {r["id"]: r for r in rows(fixture_tables.activity)}
    after = {r["id"]: r for r in rows(t.activity)}
    link = "user_productivity_daily_detail"
    assert before.keys() == after.keys()
    for i, old in before.items():
        moved = old["productivity_base"] != after[i]["productivity_base"]
        assert after[i][link] == (None if moved or old[link] in affected else old[link])
    assert t.base.select("id").distinct().count() == t.base.count()


def test_version_chain(spark):
    """Three duplicates of a name need two runs, each on what the last one published."""
    root = tempfile.mkdtemp(prefix="worklens-chain-")
    t = _scenario(spark)
    names = frame(spark, "productivity_base", [{"id": 90 + i, "resource_name": "thrice"} for i in range(3)])
    write_version(t.replace(productivity_base=t.base.unionByName(names)).as_dict(), root, "v0")
    left = []
    for version, now in (("v1", ts(2024, 6, 1)), ("v2", ts(2024, 6, 2)), ("v3", ts(2024, 6, 3))):
        result = job.browser_reclassify(read_tables(spark, root), now)
        job.publish(result, root, version, root)
        back = read_tables(spark, root)
        left.append(back.base.where("resource_name = 'thrice' and expired_on is null").count())
        assert back.users.count() == 0 and back.activity.count() == 8
    assert left == [2, 1, 1]
    assert read_tables(spark, os.path.join(root, "v0")).base.where("expired_on is not null").count() == 0


def test_versions_are_written_once_and_only_visible_whole(spark):
    root = tempfile.mkdtemp(prefix="worklens-once-")
    t = _scenario(spark)
    write_version(t.as_dict(), root, "v0")
    with pytest.raises(FileExistsError):
        write_version(t.as_dict(), root, "v0")
    with pytest.raises(ValueError):
        write_version({"productivity_base": t.base}, root, "v1")
    full = frame(spark, "user_session", [{"system_user": 1}])
    broken = t.replace(user_session=full.withColumn("machine_name", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        write_version(broken.as_dict(), root, "v1")
    assert [os.path.basename(p) for p in published_versions(spark, root)] == ["v0"]
    assert read_tables(spark, root).base.count() == t.base.count()


def test_reading_steps_fires_no_job(spark, fixture_tables):
    """Building a step runs nothing but the id numbering where new entries are needed."""
    def jobs_of(build) -> int:
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "")
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    steps = job.BrowserReclassify(fixture_tables, NOW)
    for name in ("expired", "snapshot", "candidates", "affected", "detail"):
        assert jobs_of(lambda: getattr(steps, name)) == 0, name
    assert jobs_of(lambda: steps.catalogue) > 0
    assert jobs_of(lambda: (steps.reassigned, steps.activity)) == 0


def test_global_ordinal_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("v"))
    out = global_ordinal(df.repartition(5), [F.desc("v")])
    got = [(r["v"], r["ordinal"]) for r in out.collect()]
    assert sorted(o for _, o in got) == list(range(1, 5001))
    assert all(v == 5000 - o for v, o in got)


def test_left_join_spreading_nulls_matches_plain_left_join(spark):
    left = spark.createDataFrame([(i, None if i % 3 == 0 else i % 10) for i in range(300)], "id bigint, k bigint")
    right = spark.createDataFrame([(k, k * 100) for k in range(0, 10, 2)], "k bigint, v bigint")
    a = left_join_spreading_nulls(left, right, "k", ["id"])
    b = left.join(right, "k", "left")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_tables_round_trip(spark, fixture_tables):
    root = tempfile.mkdtemp(prefix="worklens-tables-")
    write_version(fixture_tables.as_dict(), root, "v0")
    back = read_tables(spark, os.path.join(root, "v0"))
    assert sorted(os.listdir(os.path.join(root, "v0", "user_productivity_daily_detail")))[-1].startswith("date=")
    for name, frame in fixture_tables.as_dict().items():
        copy = back.as_dict()[name]
        assert [(f.name, f.dataType) for f in copy.schema] == [(f.name, f.dataType) for f in frame.schema], name
        assert copy.exceptAll(frame).count() == 0 and frame.exceptAll(copy).count() == 0, name


def test_join_spreading_key_matches_plain_join(spark):
    left = spark.createDataFrame([(i, None if i % 3 == 0 else 1 if i % 2 else i % 10) for i in range(300)], "id bigint, k bigint")
    right = spark.createDataFrame([(k, k * 100) for k in (0, 1, 2, 4)], "k bigint, v bigint")
    for how in ("left", "inner"):
        a, b = join_spreading_key(left, right, "k", ["id"], how), left.join(right, "k", how)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_global_ordinal_of_nothing_is_empty(spark):
    empty = spark.range(0).select(F.col("id").alias("v"))
    assert global_ordinal(empty, [F.asc("v")]).count() == 0


def test_materialize_keeps_rows(spark):
    df = spark.range(0, 1000, numPartitions=4).withColumn("w", F.col("id") % 7)
    kept = materialize(df, "test")
    assert kept.exceptAll(df).count() == 0 and df.exceptAll(kept).count() == 0


def test_partitioned_write_keeps_few_files_per_day(spark, fixture_tables):
    from worklens.sources.tables import write_table

    path = os.path.join(tempfile.mkdtemp(prefix="worklens-layout-"), "detail")
    # a detail table spread over many partitions, as after a shuffle on another key
    write_table(fixture_tables.detail.repartition(16, "oid"), path, ["date"])
    days = [d for d in os.listdir(path) if d.startswith("date=")]
    files = {d: [f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")] for d in days}
    assert days and max(len(v) for v in files.values()) <= 2
