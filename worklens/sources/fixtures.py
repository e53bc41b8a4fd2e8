"""Activity tables derived from the driver's synthetic parquet tables.

No activity data ships with the task, so the ten tables the jobs read are
derived, row for row, from ``events customer supplier part nation region
pages`` (see FIXTURES.md). Every derived table grows with the scale factor:
the catalogue is the whole ``part`` table, the roll-up detail has one row per
event, activity one row per event. Facts refer to the whole catalogue and all
pages (modulo their row counts), so the number of resources and sites grows
too. Skew is built in at every scale: user 0 has a third of all rows, resource
7 a quarter of the roll-up, the three browsers a third of the activity, one
site a seventh of the titles, and a third of the activity has no link.
Modular arithmetic only *shapes* values; it never drops source rows.

``events.ts`` covers one month, so each event is shifted by 0/30/60/90 days
to give the reports several months.

The derivations are Spark SQL over the raw tables read with declared
schemas (no schema-inference job per file), one statement per table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from worklens.sources.tables import Tables

RAW_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
}

EXPIRED = "TIMESTAMP_NTZ '2023-06-01 00:00:00'"

# Fixed fixture values: catalogue names given to the first six part keys, so
# that the browser, lock-screen, blank and NULL cases occur at every scale.
FIXTURE_SQL = {
    "ev": """
SELECT event_id, value, timestampadd(DAY, (event_id % 4) * 30, ts) AS ts2,
       CASE WHEN event_id % 3 = 1 THEN 0 ELSE user_id END AS user_id,
       CAST(floor(value * 10) AS INT) + CASE WHEN user_id % 10 = 0 THEN 20000 ELSE 0 END AS dur,
       (SELECT count(*) FROM {part}) AS n_parts, (SELECT count(*) FROM {pages}) AS n_pages
FROM {events}""",
    "productivity_base": f"""
SELECT p_partkey AS id,
       CASE p_partkey WHEN 0 THEN 'google chrome - chrome.exe' WHEN 1 THEN 'firefox - firefox.exe'
            WHEN 2 THEN 'opera internet browser - opera.exe' WHEN 3 THEN 'Windows LockApp.exe'
            WHEN 4 THEN '  ' WHEN 5 THEN NULL ELSE p_name END AS resource_name,
       CASE WHEN p_partkey % 11 = 6 THEN {EXPIRED} END AS expired_on,
       CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 2 THEN 0 ELSE 1 END AS browser_related,
       CAST(NULL AS INT) AS application_or_website,
       CAST(NULL AS TIMESTAMP_NTZ) AS created_on, CAST(NULL AS TIMESTAMP_NTZ) AS saved_on
FROM {{part}}""",
    "user_productivity_daily_detail": """
SELECT event_id AS oid, CAST(CAST(ts2 AS DATE) AS TIMESTAMP_NTZ) AS date, hour(ts2) AS hour_from,
       ts2 AS activity_start, timestampadd(SECOND, dur, ts2) AS activity_end, dur AS daily_duration,
       CAST(CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_id % 5 END AS INT) AS adjusted_productivity_type,
       user_id AS system_user, CASE WHEN event_id % 4 = 1 THEN 7 ELSE event_id % n_parts END AS productivity_base,
       CAST(user_id * 100000000 + year(ts2) * 10000 + month(ts2) * 100 + day(ts2) AS BIGINT)
           AS user_productivity_daily
FROM {ev}""",
    "user_productivity_daily": """
SELECT DISTINCT user_productivity_daily AS oid, date FROM {detail}""",
    "user_activity": """
SELECT e.event_id AS id, e.ts2 AS first_captured_on,
       CASE e.event_id % 7 WHEN 0 THEN p.url
            WHEN 1 THEN 'Report ' || CAST(e.event_id % e.n_pages AS STRING) || '.pdf - viewer'
            WHEN 2 THEN 'page' || CAST(e.event_id div 7 % e.n_parts AS STRING) || '.html'
            WHEN 3 THEN 'Default' || CAST(e.event_id % 5 AS STRING) || '.aspx?q=1'
            WHEN 4 THEN 'portal./Search?q=' || CAST(e.event_id AS STRING)
            WHEN 5 THEN '   ' END AS description,
       p.url AS url, CAST(floor(e.value * 10 / 3) AS INT) AS active_duration,
       CASE WHEN e.event_id % 3 = 0 THEN e.event_id div 3 % 3 ELSE e.event_id * 7 % e.n_parts END AS productivity_base,
       CASE WHEN e.event_id % 3 = 2 OR e.event_id % 50 = 3 THEN CAST(NULL AS BIGINT)
            ELSE e.event_id - e.event_id % 3 END AS user_productivity_daily_detail,
       CASE WHEN e.event_id % 2 = 0 THEN 4 ELSE 8 END AS object_type,
       CASE WHEN e.event_id % 20 = 9 THEN 1 ELSE 0 END AS inactivity_set
FROM {ev} e LEFT JOIN {pages} p ON p.page_id = e.event_id % e.n_pages""",
    "system_user": f"""
SELECT c_custkey AS oid, 'CORP/' || c_name AS name,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'F ' || c_name END AS friendly_name,
       c_mktsegment AS comment,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS working_department,
       CASE WHEN c_custkey % 13 = 12 THEN {EXPIRED} END AS expired_on
FROM {{customer}}""",
    "department": """
SELECT CAST(n_nationkey AS BIGINT) AS oid, n_name AS name FROM {nation}""",
    "user_session": """
SELECT user_id AS system_user,
       CASE WHEN event_id % 29 = 28 THEN NULL ELSE 'PC-' || CAST(event_id % 5 AS STRING) END AS machine_name,
       ts2 AS save_date
FROM {ev}""",
    "filtering_group": f"""
SELECT CAST(r_regionkey AS BIGINT) AS id, r_regionkey % 2 AS user_inclusion_type,
       CASE WHEN r_regionkey = 4 THEN {EXPIRED} END AS expired_on
FROM {{region}}""",
    "system_user_to_group": f"""
SELECT c_custkey AS system_user, CAST(c_nationkey % 5 AS BIGINT) AS filtering_group,
       CASE WHEN c_custkey % 17 = 16 THEN {EXPIRED} END AS expired_on
FROM {{customer}}
UNION ALL
SELECT c_custkey, CAST((c_nationkey + 2) % 5 AS BIGINT), CAST(NULL AS TIMESTAMP_NTZ)
FROM {{customer}} WHERE c_custkey % 3 = 0""",
    "app_user_to_group": f"""
SELECT s_suppkey AS app_user, CAST(s_nationkey % 5 AS BIGINT) AS filtering_group,
       CASE WHEN s_suppkey % 9 = 8 THEN {EXPIRED} END AS expired_on
FROM {{supplier}}
UNION ALL
SELECT s_suppkey, CAST((s_nationkey + 2) % 5 AS BIGINT), CAST(NULL AS TIMESTAMP_NTZ)
FROM {{supplier}} WHERE s_suppkey % 2 = 0""",
}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    raw = {name: raw_table(spark, sf_dir, name) for name in RAW_SCHEMAS}
    ev = spark.sql(FIXTURE_SQL["ev"], events=raw["events"], part=raw["part"], pages=raw["pages"])
    detail = spark.sql(FIXTURE_SQL["user_productivity_daily_detail"], ev=ev)

    def derive(name: str, **frames: DataFrame) -> DataFrame:
        return spark.sql(FIXTURE_SQL[name], **frames)

    return Tables(
        user_activity=derive("user_activity", ev=ev, pages=raw["pages"]),
        productivity_base=derive("productivity_base", part=raw["part"]),
        user_productivity_daily_detail=detail,
        user_productivity_daily=derive("user_productivity_daily", detail=detail),
        system_user=derive("system_user", customer=raw["customer"]),
        department=derive("department", nation=raw["nation"]),
        user_session=derive("user_session", ev=ev),
        filtering_group=derive("filtering_group", region=raw["region"]),
        system_user_to_group=derive("system_user_to_group", customer=raw["customer"]),
        app_user_to_group=derive("app_user_to_group", supplier=raw["supplier"]),
    )
