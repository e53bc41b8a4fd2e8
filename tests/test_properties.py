"""Randomised checks of the column expressions against plain Python.

Each property evaluates a whole batch of generated values in one DataFrame,
so a handful of examples covers hundreds of inputs.
"""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from worklens.functions import TITLE_DELIMITERS, clock_time, duration_text, site_name, truncated_avg

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def py_clock(s: int) -> str:
    s %= 86400
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def py_duration(s: int) -> str:
    return f"[{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}]"


def py_site(title: str) -> str:
    out = title
    for d in TITLE_DELIMITERS:
        pos = out.lower().find(d.lower())
        if pos >= 0:
            out = out[:pos]
    return out[:500]


@SETTINGS
@given(st.lists(st.integers(min_value=-10**9, max_value=10**9), min_size=1, max_size=300))
def test_clock_time_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s bigint")
    got = [r.t for r in df.select(clock_time(F.col("s")).alias("t")).collect()]
    assert got == [py_clock(v) for v in values]


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=10**9), min_size=1, max_size=300))
def test_duration_text_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s bigint")
    got = [r.t for r in df.select(duration_text(F.col("s")).alias("t")).collect()]
    assert got == [py_duration(v) for v in values]


_pieces = st.sampled_from(["aspx", "ASPX", ".htm", ".HTML", ".pdf", "./Search", "./search", ".com/", ".COM/",
                           "news", "a", ".", "/", " ", "\n", "é", "x" * 120])
_titles = st.lists(_pieces, min_size=0, max_size=12).map("".join)


@SETTINGS
@given(st.lists(_titles, min_size=1, max_size=200))
def test_site_name_matches_sequential_find(spark, titles):
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = [r.s for r in df.select(site_name(F.col("t")).alias("s")).collect()]
    assert got == [py_site(t) for t in titles]


@SETTINGS
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(-10**6, 10**6)), min_size=1, max_size=8),
                min_size=1, max_size=40))
def test_truncated_avg_matches_python(spark, groups):
    rows = [(g, v) for g, values in enumerate(groups) for v in values]
    df = spark.createDataFrame(rows, "g int, v bigint")
    got = {r.g: r.a for r in df.groupBy("g").agg(truncated_avg(F.col("v")).alias("a")).collect()}

    def py_avg(values):
        present = [v for v in values if v is not None]
        if not present:
            return None
        q = abs(sum(present)) // len(present)
        return q if sum(present) >= 0 else -q

    assert got == {g: py_avg(values) for g, values in enumerate(groups)}


_detail_rows = st.lists(
    st.tuples(st.integers(1, 28), st.integers(0, 23), st.one_of(st.none(), st.integers(0, 5000)),
              st.one_of(st.none(), st.integers(0, 4)), st.integers(1, 3), st.sampled_from([3, 10, 11])),
    min_size=1, max_size=120)


@SETTINGS
@given(_detail_rows)
def test_work_hour_split_equals_self_join(spark, items):
    import datetime as dt

    from worklens.operators import rollup
    from conftest import frame

    base = frame(spark, "productivity_base", [{"id": 3, "resource_name": "LockApp"},
                                              {"id": 10, "resource_name": "Word"}, {"id": 11, "resource_name": "mail"}])
    detail = frame(spark, "user_productivity_daily_detail", [
        {"oid": i, "date": dt.datetime(2024, 1, d), "hour_from": h,
         "activity_start": dt.datetime(2024, 1, d, h, 5), "activity_end": dt.datetime(2024, 1, d, h, 50),
         "daily_duration": dur, "adjusted_productivity_type": t, "system_user": u, "productivity_base": r}
        for i, (d, h, dur, t, u, r) in enumerate(items)])
    got = rollup.user_day_work_hours(detail, base, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 25), (9, 19), (2, 6))

    up, wh = detail.alias("up"), detail.alias("wh")
    cond = ((F.col("up.oid") == F.col("wh.oid")) & F.col("wh.hour_from").between(9, 19)
            & F.dayofweek("wh.date").between(2, 6))
    keep = base.where(~F.lower("resource_name").contains("lockapp")).select(F.col("id").alias("pb"))
    ptype, dur = F.col("wh.adjusted_productivity_type"), F.col("wh.daily_duration")
    expected = (
        up.join(keep, F.col("up.productivity_base") == F.col("pb"))
        .where(F.col("up.date").between(F.lit("2024-01-03").cast("timestamp_ntz"),
                                        F.lit("2024-01-25").cast("timestamp_ntz")))
        .join(wh, cond, "left")
        .groupBy(F.col("up.date").alias("date"), F.col("up.system_user").alias("system_user"))
        .agg(F.sum(dur).alias("sum_daily_duration_wh"),
             F.sum(F.when(ptype == 1, dur)).alias("sum_productive_wh"),
             F.sum(F.when(F.coalesce(ptype, F.lit(0)) == 0, dur)).alias("sum_undefined_wh"),
             F.min("wh.activity_start").alias("min_activity_start_wh"),
             F.max("wh.activity_end").alias("max_activity_end_wh"))
    )
    cols = ["date", "system_user", "sum_daily_duration_wh", "sum_productive_wh", "sum_undefined_wh",
            "min_activity_start_wh", "max_activity_end_wh"]
    a, b = got.select(*cols), expected.select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
