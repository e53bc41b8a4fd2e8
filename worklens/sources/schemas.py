"""Declared schemas of the activity tables.

Durations are integer seconds, ``date`` columns are midnight-valued
TIMESTAMP_NTZ, ``expired_on IS NULL`` marks an active row (soft delete).
Keys are bigint surrogates; GUID keys of a live system read as strings work
unchanged with every job, since keys are only compared for equality.
"""

from __future__ import annotations

from pyspark.sql.types import (
    IntegerType as I,
    LongType as L,
    StringType as S,
    StructField,
    StructType,
    TimestampNTZType as TS,
)


def _struct(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype(), True) for name, dtype in fields])


USER_ACTIVITY = _struct(
    ("id", L), ("first_captured_on", TS), ("description", S), ("url", S),
    ("active_duration", I), ("productivity_base", L), ("user_productivity_daily_detail", L),
    ("object_type", I), ("inactivity_set", I),
)

PRODUCTIVITY_BASE = _struct(
    ("id", L), ("resource_name", S), ("expired_on", TS), ("browser_related", I),
    ("application_or_website", I), ("created_on", TS), ("saved_on", TS),
)

USER_PRODUCTIVITY_DAILY_DETAIL = _struct(
    ("oid", L), ("date", TS), ("hour_from", I), ("activity_start", TS), ("activity_end", TS),
    ("daily_duration", I), ("adjusted_productivity_type", I), ("system_user", L),
    ("productivity_base", L), ("user_productivity_daily", L),
)

USER_PRODUCTIVITY_DAILY = _struct(("oid", L), ("date", TS))

SYSTEM_USER = _struct(
    ("oid", L), ("name", S), ("friendly_name", S), ("comment", S),
    ("working_department", L), ("expired_on", TS),
)

DEPARTMENT = _struct(("oid", L), ("name", S))

USER_SESSION = _struct(("system_user", L), ("machine_name", S), ("save_date", TS))

FILTERING_GROUP = _struct(("id", L), ("user_inclusion_type", I), ("expired_on", TS))

SYSTEM_USER_TO_GROUP = _struct(("system_user", L), ("filtering_group", L), ("expired_on", TS))

APP_USER_TO_GROUP = _struct(("app_user", L), ("filtering_group", L), ("expired_on", TS))

TABLE_SCHEMAS: dict[str, StructType] = {
    "user_activity": USER_ACTIVITY,
    "productivity_base": PRODUCTIVITY_BASE,
    "user_productivity_daily_detail": USER_PRODUCTIVITY_DAILY_DETAIL,
    "user_productivity_daily": USER_PRODUCTIVITY_DAILY,
    "system_user": SYSTEM_USER,
    "department": DEPARTMENT,
    "user_session": USER_SESSION,
    "filtering_group": FILTERING_GROUP,
    "system_user_to_group": SYSTEM_USER_TO_GROUP,
    "app_user_to_group": APP_USER_TO_GROUP,
}
