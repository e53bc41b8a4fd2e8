"""Column expressions: clock text, integer averages, name matching, site names."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens.functions import (
    clock_time,
    duration_text,
    key_in,
    name_key,
    not_lock_screen,
    site_name,
    truncated_avg,
    weekday,
)
from worklens.functions.calendar import first_of_month
from conftest import ts


def test_clock_time_wraps_past_a_day(spark):
    df = spark.createDataFrame([(0,), (59,), (3600,), (86399,), (86400,), (90061,), (-5,), (None,)], "s bigint")
    got = [r.t for r in df.select(clock_time(F.col("s")).alias("t")).collect()]
    assert got == ["00:00:00", "00:00:59", "01:00:00", "23:59:59", "00:00:00", "01:01:01", "23:59:55", None]


def test_duration_text_keeps_hours(spark):
    df = spark.createDataFrame([(0,), (61,), (90061,), (360000,), (None,)], "s bigint")
    got = [r.t for r in df.select(duration_text(F.col("s")).alias("t")).collect()]
    assert got == ["[0:00:00]", "[0:01:01]", "[25:01:01]", "[100:00:00]", None]


def test_truncated_average_rounds_toward_zero(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, -1), (2, -2), (3, None)], "g int, v int")
    got = {r.g: r.a for r in df.groupBy("g").agg(truncated_avg(F.col("v")).alias("a")).collect()}
    assert got == {1: 1, 2: -1, 3: None}


def test_name_key_ignores_case_and_trailing_blanks(spark):
    df = spark.createDataFrame([("Chrome  ",), ("chrome",), (" chrome",), (None,)], "n string")
    got = [r.k for r in df.select(name_key(F.col("n")).alias("k")).collect()]
    assert got == ["chrome", "chrome", " chrome", None]


def test_lock_screen_filter_is_case_insensitive_and_drops_null(spark):
    df = spark.createDataFrame([("Windows LockApp.exe",), ("lockapp",), ("word",), (None,)], "n string")
    assert [r.n for r in df.where(not_lock_screen(F.col("n"))).collect()] == ["word"]


def test_browser_membership_uses_name_keys(spark):
    df = spark.createDataFrame([("Google Chrome - chrome.exe ",), ("firefox - firefox.exe",), ("edge",)], "n string")
    names = ["google chrome - chrome.exe", "firefox - firefox.exe"]
    assert df.where(key_in(F.col("n"), names)).count() == 2


def test_site_name_cuts_each_delimiter_in_turn(spark):
    titles = [
        "Report 3.PDF - viewer", "page1.html", "Default3.aspx?q=1", "portal./search?q=5",
        "www.example.com/path", "plain title", "multi\nline.htm x", "aspx first", None,
    ]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = [r.s for r in df.select(site_name(F.col("t")).alias("s")).collect()]
    assert got == ["Report 3", "page1", "Default3.", "portal", "www.example", "plain title", "multi\nline", "", None]


def test_site_name_caps_length(spark):
    df = spark.createDataFrame([("x" * 800,)], "t string")
    assert len(df.select(site_name(F.col("t")).alias("s")).first().s) == 500


def test_weekday_sunday_is_one(spark):
    df = spark.createDataFrame([(ts(2024, 1, 7),), (ts(2024, 1, 8),), (ts(2024, 1, 13),)], "d timestamp_ntz")
    assert [r.w for r in df.select(weekday(F.col("d")).alias("w")).collect()] == [1, 2, 7]


def test_first_of_month():
    assert first_of_month(ts(2024, 12, 15)) == ts(2024, 12, 1)
    assert first_of_month(ts(2024, 12, 15), 1) == ts(2025, 1, 1)


def test_seconds_since_midnight_counts_whole_seconds(spark):
    from worklens.functions import seconds_since

    df = spark.createDataFrame([(ts(2024, 1, 8), ts(2024, 1, 8, 0, 0, 1, 500000)),
                                (ts(2024, 1, 8), ts(2024, 1, 9, 0, 0, 2))], "d timestamp_ntz, t timestamp_ntz")
    got = [r.s for r in df.select(seconds_since(F.col("d"), F.col("t")).alias("s")).collect()]
    assert got == [1, 86402]
