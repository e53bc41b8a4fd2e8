"""The browser re-attribution job: all eight steps in order, as one job.

The browser snapshot is taken before any activity changes, and every later
step reads that snapshot (not the updated activity). What later steps need of
it are aggregates, the time per site and browser and the distinct roll-up ids;
a published run writes what both come from to shared storage once.

Publishing rewrites only the days of activity and roll-up on which a row
changes; all other days of the next version are the files of the last one.
"""

from __future__ import annotations

import datetime as _dt
import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions import BROWSER_RESOURCE_NAMES, NOCASE, Names, name_key, ntz
from worklens.operators import reclassify as step
from worklens.plans.distributed import NO_HOT_KEYS, HotKeys, hot_keys, hot_keys_of_counts, materialize
from worklens.sources import versions
from worklens.sources.tables import Tables, table_locations, write_version

CATALOGUE, ACTIVITY, DETAIL = CHANGED = ("productivity_base", "user_activity", "user_productivity_daily_detail")


class BrowserReclassify:
    """The steps over one version of the tables, each built when it is asked for.

    With ``keep`` what several steps read is made once when a step needs it:
    the browser entries of the catalogue and the entry of each site (whose true
    sizes Spark then knows before it plans the joins to the activity) and the
    snapshot's links are written to shared storage, and the hot resources are
    sketched and the hot sites counted, so that their rows are spread.
    Without, every step is one lazy plan (apart from the id numbering of
    ``catalogue``), in which adaptive execution alone splits hot keys.
    """

    def __init__(self, tables: Tables, as_of: _dt.datetime, browsers: Sequence[str] = BROWSER_RESOURCE_NAMES,
                 min_seconds: int = step.MIN_SITE_SECONDS, keep: bool = False, names: Names = NOCASE):
        self.before, self.as_of, self.browsers, self.min_seconds = tables, as_of, browsers, min_seconds
        self.keep, self.names = keep, names

    def _kept(self, frame: DataFrame, name: str) -> DataFrame:
        return materialize(frame, name) if self.keep else frame

    @functools.cached_property
    def expired(self) -> DataFrame:
        return step.expire_duplicate_resources(self.before.base, self.as_of, self.names)

    @functools.cached_property
    def _entries(self) -> DataFrame:
        """What the snapshot needs of the catalogue it is taken against."""
        return self._kept(step.browser_entries(self.before.base, self.browsers, self.names), "browser-entries")

    @functools.cached_property
    def _hot_resources(self) -> HotKeys:
        return hot_keys(self.before.activity, "productivity_base") if self.keep else NO_HOT_KEYS

    @functools.cached_property
    def snapshot(self) -> DataFrame:
        return step.browser_activity_extract(self.before.activity, self._entries, self.before.detail, self.browsers,
                                             self._hot_resources, self.names)

    @functools.cached_property
    def _links(self) -> DataFrame:
        return materialize(step.site_links(self.snapshot), "site-links")

    @functools.cached_property
    def _site_times(self) -> DataFrame:
        return step.site_times_of(self._links) if self.keep else step.site_times(self.snapshot)

    @functools.cached_property
    def _hot_sites(self) -> HotKeys:
        if not self.keep:
            return NO_HOT_KEYS
        times = self._site_times.withColumn("_site", name_key(F.col("new_resource_name"), self.names))
        return hot_keys_of_counts(times, "_site", "rows")

    @functools.cached_property
    def candidates(self) -> DataFrame:
        return step.candidates_of(self._site_times, self.expired, self.min_seconds, self.names)

    @functools.cached_property
    def catalogue(self) -> DataFrame:
        return step.register_resources(self.expired, self.candidates, self.as_of, self.names)

    @functools.cached_property
    def _targets(self) -> DataFrame:
        return self._kept(step.site_targets(self.catalogue, self.names), "site-targets")

    @functools.cached_property
    def reassigned(self) -> DataFrame:
        return step.reassign_activity(self.before.activity, self._entries, self.catalogue, self.browsers,
                                      self._hot_resources, self._hot_sites, self.names)

    @functools.cached_property
    def affected(self) -> DataFrame:
        return step.affected_details(self._links if self.keep else self.snapshot)

    def next_activity(self, rows: DataFrame, changes_only: bool = False) -> DataFrame:
        """The next version of some rows of the activity."""
        return step.next_activity(rows, self._entries, self._targets, self.affected, self.browsers,
                                  self._hot_resources, self._hot_sites, changes_only, self.names)

    @functools.cached_property
    def activity(self) -> DataFrame:
        return self.next_activity(self.before.activity)

    @functools.cached_property
    def detail(self) -> DataFrame:
        return step.drop_details(self.before.detail, self.affected)

    @functools.cached_property
    def tables(self) -> Tables:
        """The next version: catalogue, activity and roll-up replaced."""
        return self.before.replace(productivity_base=self.catalogue, user_activity=self.activity,
                                   user_productivity_daily_detail=self.detail)

    def touched_days(self, table: str) -> list[_dt.date | None]:
        """The days on which a row of the activity or the roll-up changes: a
        distributed pass over the columns that decide it, then one row a day."""
        changed = (self.next_activity(self.before.activity, changes_only=True) if table == ACTIVITY
                   else step.details_to_drop(self.before.detail, self.affected))
        days = [r["day"] for r in step.days_of(table, changed).collect()]
        return sorted(days, key=lambda d: (d is not None, d))


def browser_reclassify(tables: Tables, as_of: _dt.datetime,
                       browsers: Sequence[str] = BROWSER_RESOURCE_NAMES,
                       min_seconds: int = step.MIN_SITE_SECONDS, names: Names = NOCASE) -> BrowserReclassify:
    return BrowserReclassify(tables, as_of, browsers, min_seconds, keep=True, names=names)


def publish(result: BrowserReclassify, root: str, version: str, source: str) -> str:
    """Publish the next version of the tables as ``root/version``.

    Where the tables come from a published version (or from folders laid out
    by day), activity and roll-up are written for the days that change only;
    seven tables and all other days stay where that version has them. The
    version read is the parent: if another run has published meanwhile this
    one fails with ``versions.StaleParent``, and its changes can be computed
    again from the newest version. Dropping roll-up rows keeps what is proven
    of the others.
    """
    before = result.before
    spark = before.base.sparkSession
    where = before.version.tables if before.version else table_locations(spark, source)
    parent = before.version if before.version and before.version.root == versions.qualified(spark, root) else None
    facts = before.version.facts if before.version else None
    if not {ACTIVITY, DETAIL} <= set(before.by_day):
        unchanged = {name: parts for name, parts in where.items() if name not in CHANGED}
        return write_version({name: result.tables.as_dict()[name] for name in CHANGED}, root, version, unchanged,
                             parent, facts=facts)
    days = {name: result.touched_days(name) for name in (ACTIVITY, DETAIL)}
    frames = {
        CATALOGUE: result.catalogue,
        ACTIVITY: result.next_activity(before.on_days(ACTIVITY, days[ACTIVITY])),
        DETAIL: step.drop_details(before.on_days(DETAIL, days[DETAIL]), result.affected),
    }
    return write_version(frames, root, version, {name: parts for name, parts in where.items() if name != CATALOGUE},
                         parent, days, facts)


def summary(result: BrowserReclassify, as_of: _dt.datetime) -> DataFrame:
    """(metric, value) rows describing the next version.

    One global aggregate per table (conditional counts side by side), each
    unpivoted to rows and stacked with a union: every table's plan runs once,
    and no cross join is needed.
    """
    t = result.tables
    now = ntz(as_of)

    def counts(frame: DataFrame, metrics: dict[str, object]) -> DataFrame:
        cols = [F.count(F.lit(1)).alias(name) if cond is None
                else F.count_if(cond).alias(name) for name, cond in metrics.items()]
        return frame.agg(*cols).unpivot([], list(metrics), "metric", "value")

    parts = [
        counts(t.base, {"catalogue_rows": None,
                        "catalogue_added": F.col("created_on") == now,
                        "catalogue_expired_now": F.col("expired_on") == now}),
        counts(t.activity, {"activity_rows": None,
                            "activity_unlinked": F.col("user_productivity_daily_detail").isNull()}),
        counts(t.detail, {"detail_rows": None}),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
