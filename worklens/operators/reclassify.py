"""Browser re-attribution: time recorded against a browser is moved to the
site behind it.

Each step is a pure function returning the next version of a table (the
original statements updated, inserted and deleted in place):

1. :func:`expire_duplicate_resources` - expire one duplicate catalogue row per name.
2. :func:`browser_activity_extract` - snapshot of browser activity with the site name.
3. :func:`new_resource_candidates` - site names with enough time and no active entry.
4. :func:`register_resources` - append them to the catalogue.
5. :func:`reassign_activity` - point activity at its site, unlink it from the roll-up.
6. :func:`affected_details` - roll-up rows touched by the snapshot.
7. :func:`detach_activity` - unlink all activity from those roll-up rows.
8. :func:`drop_details` - delete those roll-up rows.

``worklens.plans.reclassify`` composes them.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions import BROWSER_RESOURCE_NAMES, NOCASE, Names, is_blank, key_in, name_key, ntz, site_name
from worklens.plans.distributed import (
    NO_HOT_KEYS, HotKeys, global_ordinal, join_spreading_key, left_join_spreading_nulls,
)
from worklens.sources.tables import day_of

# Fixed value: seconds of browser time a (site, browser) pair needs before the
# site becomes a catalogue entry.
MIN_SITE_SECONDS = 30
LINK = "user_productivity_daily_detail"


def expire_duplicate_resources(base: DataFrame, as_of: _dt.datetime, names: Names = NOCASE) -> DataFrame:
    """Among active, non-blank catalogue names held by more than one row,
    expire the row with the highest id (one per name per run, so n copies
    need n-1 runs). NULL names are never touched."""
    newest_duplicate = (
        base.where(F.col("expired_on").isNull() & ~is_blank(F.col("resource_name")))
        .groupBy(name_key(F.col("resource_name"), names))
        .agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .select("id", F.lit(True).alias("_expire"))
    )
    return (
        base.join(newest_duplicate, "id", "left")
        .withColumn("expired_on", F.when(F.col("_expire"), ntz(as_of)).otherwise(F.col("expired_on")))
        .select(*base.columns)
    )


def _browser_entries(base: DataFrame, browsers: Sequence[str], names: Names) -> DataFrame:
    """(productivity_base, resource_name) of the browser entries: a handful of
    ids holding a large share of all activity, so they are only joined with
    their keys spread."""
    return base.where(key_in(F.col("resource_name"), browsers, names)).select(
        F.col("id").alias("productivity_base"), "resource_name"
    )


def _titled_with_time():
    return (F.col("active_duration") > 0) & ~is_blank(F.coalesce(F.col("description"), F.lit("")))


def browser_activity_extract(activity: DataFrame, base: DataFrame, detail: DataFrame,
                             browsers: Sequence[str] = BROWSER_RESOURCE_NAMES,
                             hot_resources: HotKeys = NO_HOT_KEYS, names: Names = NOCASE) -> DataFrame:
    """Activity with positive time on a browser entry (expired entries
    included) and a non-blank title, with the site name cut from the title.

    ``upd_oid`` is the linked roll-up row if it exists, else NULL. Activity is
    filtered by the browser entries first, with hot resources spread
    (``hot_resources``: the hot keys of activity's resource);
    activity without a link has its NULL key salted for the roll-up lookup.
    Names and ids do not change when duplicates expire, so any version of the
    catalogue since the last insert gives the same rows.
    """
    rows = join_spreading_key(activity.where(_titled_with_time()), _browser_entries(base, browsers, names),
                              "productivity_base", ["id"], "inner", hot_resources)
    snapshot = rows.select(
        "id", "first_captured_on",
        site_name(F.col("description"), names=names).alias("new_resource_name"),
        "url", "resource_name", "active_duration", LINK,
    )
    linked = left_join_spreading_nulls(
        snapshot, detail.select(F.col("oid").alias(LINK), F.col("oid").alias("upd_oid")), LINK, ["id"]
    )
    return linked.drop(LINK)


def new_resource_candidates(snapshot: DataFrame, base: DataFrame, min_seconds: int = MIN_SITE_SECONDS,
                            names: Names = NOCASE) -> DataFrame:
    """Site names whose time under one browser entry exceeds ``min_seconds``
    and that no active catalogue entry has. The threshold is per (site,
    browser) pair, so a site above it in two browsers is listed twice."""
    return candidates_of(site_times(snapshot), base, min_seconds, names)


def site_links(snapshot: DataFrame) -> DataFrame:
    """What later steps need of the snapshot: seconds and rows per exact
    spelling of site and browser and per roll-up row."""
    return snapshot.groupBy("new_resource_name", "resource_name", "upd_oid").agg(
        F.sum("active_duration").alias("seconds"), F.count(F.lit(1)).alias("rows")
    )


def site_times(snapshot: DataFrame) -> DataFrame:
    """Seconds and rows of the snapshot per exact spelling of site and browser
    (a hash aggregate, combined map-side)."""
    return site_times_of(snapshot.withColumns({"seconds": F.col("active_duration"), "rows": F.lit(1)}))


def site_times_of(links: DataFrame) -> DataFrame:
    """:func:`site_times` from :func:`site_links`."""
    return links.groupBy("new_resource_name", "resource_name").agg(
        F.sum("seconds").alias("seconds"), F.sum("rows").alias("rows")
    )


def candidates_of(times: DataFrame, base: DataFrame, min_seconds: int = MIN_SITE_SECONDS,
                  names: Names = NOCASE) -> DataFrame:
    """:func:`new_resource_candidates` from :func:`site_times`: equal spellings
    merge on the reduced rows."""
    pairs = (
        times.groupBy(
            name_key(F.col("new_resource_name"), names).alias("_site"),
            name_key(F.col("resource_name"), names).alias("_browser"),
        )
        .agg(
            F.min("new_resource_name").alias("new_resource_name"),
            F.min("resource_name").alias("existing_resource_name"),
            F.sum("seconds").alias("sum_active_duration"),
            F.sum("rows").alias("r_count"),
        )
        .where(F.col("sum_active_duration") > min_seconds)
    )
    # distinct name keys (combined map-side): catalogue names repeat, and the
    # anti-join only needs each key once
    active_names = base.where(F.col("expired_on").isNull()).select(
        name_key(F.col("resource_name"), names).alias("_site")
    ).distinct()
    return pairs.join(active_names, "_site", "left_anti").select(
        "new_resource_name", "existing_resource_name", "sum_active_duration", "r_count"
    )


def register_resources(base: DataFrame, candidates: DataFrame, as_of: _dt.datetime, names: Names = NOCASE) -> DataFrame:
    """The catalogue with one new browser-related site entry per candidate row.

    New ids continue after the current highest id, numbered in descending
    name order. The numbering is a distributed global ordinal; the highest id
    is an uncorrelated scalar subquery inside the same plan.
    """
    start = base.select(F.max("id")).scalar()
    numbered = global_ordinal(
        candidates.select("new_resource_name"),
        [F.desc_nulls_last(name_key(F.col("new_resource_name"), names)), F.desc_nulls_last("new_resource_name")],
    )
    added = numbered.select(
        (F.coalesce(start, F.lit(0)) + F.col("ordinal")).cast("bigint").alias("id"),
        F.col("new_resource_name").alias("resource_name"),
        F.lit(None).cast("timestamp_ntz").alias("expired_on"),
        F.lit(1).alias("browser_related"),
        F.lit(1).alias("application_or_website"),
        ntz(as_of).alias("created_on"),
        ntz(as_of).alias("saved_on"),
    )
    return base.unionByName(added)


def browser_entries(base: DataFrame, browsers: Sequence[str] = BROWSER_RESOURCE_NAMES, names: Names = NOCASE) -> DataFrame:
    """The catalogue rows of the browsers: all of the catalogue that the snapshot and the moves look at."""
    return base.where(key_in(F.col("resource_name"), browsers, names))


def site_targets(base: DataFrame, names: Names = NOCASE) -> DataFrame:
    """(_site, _target): the lowest active browser-related entry of each site name."""
    return (
        base.where(F.col("expired_on").isNull() & (F.col("browser_related") == 1))
        .groupBy(name_key(F.col("resource_name"), names).alias("_site"))
        .agg(F.min("id").alias("_target"))
    )


def _with_moves(activity: DataFrame, snapshot_base: DataFrame, targets: DataFrame, browsers: Sequence[str],
                hot_resources: HotKeys, hot_sites: HotKeys, names: Names) -> DataFrame:
    """``activity`` with ``_target``, the entry a row belongs to by its site, and
    whether it has to move there (``_moved``), in one pass over the rows.

    Rows outside the snapshot have no site; as NULL keys they spread over all
    partitions of the site lookup and match nothing.
    """
    entries = _browser_entries(snapshot_base, browsers, names).select("productivity_base", F.lit(True).alias("_browser"))
    rows = join_spreading_key(activity, entries, "productivity_base", ["id"], "left", hot_resources)
    sited = rows.withColumn("_site", F.when(
        F.col("_browser") & _titled_with_time(), name_key(site_name(F.col("description"), names=names), names))).drop("_browser")
    return join_spreading_key(sited, targets, "_site", ["id"], "left", hot_sites).withColumn(
        "_moved", F.coalesce(F.col("productivity_base") != F.col("_target"), F.lit(False))).drop("_site")


def _with_hits(activity: DataFrame, affected: DataFrame) -> DataFrame:
    """``activity`` with ``_hit``: whether its link is in the affected set (a NULL in the set matches nothing)."""
    hits = affected.where(F.col("upd_oid").isNotNull()).select(F.col("upd_oid").alias(LINK), F.lit(True).alias("_hit"))
    return left_join_spreading_nulls(activity, hits, LINK, ["id"]).withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def _moved_and_unlinked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "productivity_base": F.when(F.col("_moved"), F.col("_target")).otherwise(F.col("productivity_base")),
        LINK: F.when(~F.col("_moved"), F.col(LINK)),
    })


def reassign_activity(activity: DataFrame, snapshot_base: DataFrame, base: DataFrame,
                      browsers: Sequence[str] = BROWSER_RESOURCE_NAMES, hot_resources: HotKeys = NO_HOT_KEYS,
                      hot_sites: HotKeys = NO_HOT_KEYS, names: Names = NOCASE) -> DataFrame:
    """Activity of the browser snapshot whose site name has an active
    browser-related catalogue entry is moved to the lowest such id and
    unlinked from its roll-up row, unless it already points there.

    ``snapshot_base`` is the catalogue the snapshot was taken against, ``base``
    the catalogue with the new entries. Belonging to the snapshot is a per-row
    test (a lookup of the browser entries, positive time, a non-blank title),
    so activity is not joined back to the snapshot by id. One pass over the
    rows, with hot resources and hot sites spread (``hot_*``: their hot keys).
    """
    rows = _with_moves(activity, snapshot_base, site_targets(base, names), browsers, hot_resources, hot_sites, names)
    return _moved_and_unlinked(rows).select(*activity.columns)


def next_activity(activity: DataFrame, snapshot_base: DataFrame, targets: DataFrame, affected: DataFrame,
                  browsers: Sequence[str] = BROWSER_RESOURCE_NAMES, hot_resources: HotKeys = NO_HOT_KEYS,
                  hot_sites: HotKeys = NO_HOT_KEYS, changes_only: bool = False, names: Names = NOCASE) -> DataFrame:
    """:func:`reassign_activity` (to :func:`site_targets`) and then :func:`detach_activity`, in one
    pass over the rows; ``changes_only`` keeps the rows that either of them changes."""
    moves = _with_moves(activity, snapshot_base, targets, browsers, hot_resources, hot_sites, names)
    rows = _with_hits(_moved_and_unlinked(moves), affected)
    if changes_only:
        rows = rows.where(F.col("_moved") | F.col("_hit"))
    return rows.withColumn(LINK, F.when(~F.col("_hit"), F.col(LINK))).select(*activity.columns)


def days_of(table: str, rows: DataFrame) -> DataFrame:
    """The distinct days of some rows of a table laid out by day."""
    return rows.select(day_of(table).alias("day")).distinct()


def affected_details(snapshot: DataFrame) -> DataFrame:
    """Distinct roll-up ids of the snapshot, a NULL included when some
    snapshot row had no (existing) roll-up row."""
    return snapshot.select("upd_oid").distinct()


def detach_activity(activity: DataFrame, affected: DataFrame) -> DataFrame:
    """Unlink every activity row whose roll-up row is affected (a NULL in the
    affected set matches nothing)."""
    return (
        _with_hits(activity, affected)
        .withColumn(LINK, F.when(~F.col("_hit"), F.col(LINK)))
        .select(*activity.columns)
    )


def drop_details(detail: DataFrame, affected: DataFrame) -> DataFrame:
    """The roll-up table without the affected rows (anti-join: a NULL in the
    affected set removes nothing, unlike NOT IN)."""
    return detail.join(_affected_keys(affected), "oid", "left_anti")


def details_to_drop(detail: DataFrame, affected: DataFrame) -> DataFrame:
    """The rows that :func:`drop_details` removes."""
    return detail.join(_affected_keys(affected), "oid", "left_semi")


def _affected_keys(affected: DataFrame) -> DataFrame:
    return affected.where(F.col("upd_oid").isNotNull()).select(F.col("upd_oid").alias("oid"))
