"""Row-level visibility: which users a viewer may see, and the report window.

A viewer belongs to filtering groups; a group whose inclusion type is 0
lists the users it shows. If the viewer (or, for a NULL viewer, the default
viewer) has any usable membership, the visible users are the active members
of the viewer's groups; otherwise every active user is visible.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions.calendar import first_of_month

# Fixed values of the original report: dates outside these bounds are
# replaced by the current month.
EARLIEST_FROM = _dt.datetime(2016, 1, 1)
LATEST_UNTIL = _dt.datetime(2020, 1, 1)
LISTING_GROUP_TYPE = 0


def report_window(date_from: _dt.datetime, date_until: _dt.datetime,
                  as_of: _dt.datetime) -> tuple[_dt.datetime, _dt.datetime]:
    """Resolve the department report's window on the driver.

    A start before 2016-01-01 becomes the first of ``as_of``'s month; an end
    after 2020-01-01 becomes the first of the next month. Both comparisons are
    strict, so the defaults themselves pass through unchanged.
    """
    if date_from < EARLIEST_FROM:
        date_from = first_of_month(as_of)
    if date_until > LATEST_UNTIL:
        date_until = first_of_month(as_of, months_ahead=1)
    return date_from, date_until


def usable_memberships(user_groups: DataFrame, groups: DataFrame, viewer_groups: DataFrame,
                       viewer) -> DataFrame:
    """(system_user, filtering_group) memberships of active listing groups the
    viewer has an active link to. The viewer filter is applied to the
    viewer-group bridge first, so the many-to-many bridge join only ever sees
    one viewer's groups. A NULL viewer matches nothing."""
    listing = groups.where(
        (F.col("user_inclusion_type") == LISTING_GROUP_TYPE) & F.col("expired_on").isNull()
    ).select(F.col("id").alias("filtering_group"))
    viewer_col = F.lit(viewer).cast("bigint") if isinstance(viewer, int) else F.lit(viewer)
    mine = viewer_groups.where(F.col("expired_on").isNull() & (F.col("app_user") == viewer_col)).select(
        "filtering_group"
    ).distinct()
    return (
        user_groups.where(F.col("expired_on").isNull())
        .select("system_user", "filtering_group")
        .join(listing, "filtering_group", "left_semi")
        .join(mine, "filtering_group", "left_semi")
    )


def visible_users(users: DataFrame, user_groups: DataFrame, groups: DataFrame, viewer_groups: DataFrame,
                  viewer, default_viewer) -> DataFrame:
    """Distinct ``system_user`` ids the viewer may see.

    The existence test uses ``viewer`` or, when it is NULL, ``default_viewer``;
    the member list uses ``viewer`` itself, so a NULL viewer whose default has
    groups sees nobody. One plan: active users left-joined to the viewer's
    members, kept when they are members or when no usable membership exists.
    The existence test is an uncorrelated EXISTS, evaluated once as a scalar
    subquery (no driver round trip, no cross join).
    """
    evaluated = default_viewer if viewer is None else viewer
    tested = usable_memberships(user_groups, groups, viewer_groups, evaluated)
    listed = tested if viewer is not None else usable_memberships(user_groups, groups, viewer_groups, None)
    members = listed.select(F.col("system_user").alias("oid")).distinct().withColumn("_member", F.lit(True))
    return (
        users.where(F.col("expired_on").isNull()).select("oid")
        .join(members, "oid", "left")
        .where(F.coalesce(F.col("_member"), F.lit(False)) | ~tested.exists())
        .select(F.col("oid").alias("system_user"))
    )
