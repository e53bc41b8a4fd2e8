"""The set of activity tables a job reads, and the writing of next versions.

Jobs never mutate a table in place: an UPDATE/DELETE/INSERT of the original
scripts becomes a pure ``DataFrame -> DataFrame`` producing the next version.
:func:`write_version` writes what changed, whole tables or only the days of a
table that changed, to a fresh folder and publishes the version
(:mod:`worklens.sources.versions`); :func:`read_tables` reads a version, or the
newest published one.

The four large tables are laid out by day (:data:`DAY_LAYOUT`): the roll-up
tables by their ``date``, activity and sessions by a generated ``day`` of their
timestamp. That column is not part of a table's schema; :meth:`Tables.between`
and :meth:`Tables.on_days` turn bounds on the timestamp into bounds on it.
"""

from __future__ import annotations

import dataclasses
import datetime as _dt
import functools
import os
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from worklens.functions import ntz
from worklens.sources import versions
from worklens.sources.schemas import TABLE_SCHEMAS
from worklens.sources.versions import Part, Parts, Version

DAY = "day"
# Partition column and the column it is the day of, per table laid out by day.
DAY_LAYOUT: dict[str, tuple[str, str]] = {
    "user_productivity_daily_detail": ("date", "date"),
    "user_productivity_daily": ("date", "date"),
    "user_activity": (DAY, "first_captured_on"),
    "user_session": (DAY, "save_date"),
}


@dataclasses.dataclass(frozen=True)
class Tables:
    user_activity: DataFrame
    productivity_base: DataFrame
    user_productivity_daily_detail: DataFrame
    user_productivity_daily: DataFrame
    system_user: DataFrame
    department: DataFrame
    user_session: DataFrame
    filtering_group: DataFrame
    system_user_to_group: DataFrame
    app_user_to_group: DataFrame
    # The published version these tables are, if they are one, and the frames
    # of its tables that are laid out by day, with the partition column.
    version: Version | None = None
    by_day: Mapping[str, DataFrame] = dataclasses.field(default_factory=dict)

    # short aliases used throughout the operators
    @property
    def activity(self) -> DataFrame:
        return self.user_activity

    @property
    def base(self) -> DataFrame:
        return self.productivity_base

    @property
    def detail(self) -> DataFrame:
        return self.user_productivity_daily_detail

    @property
    def daily(self) -> DataFrame:
        return self.user_productivity_daily

    @property
    def users(self) -> DataFrame:
        return self.system_user

    def replace(self, **changes: DataFrame) -> Tables:
        """These tables with some replaced: no published version any more."""
        by_day = {name: frame for name, frame in self.by_day.items() if name not in changes}
        return dataclasses.replace(self, **changes, version=None, by_day=by_day)

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_SCHEMAS}

    def proves(self, fact: str) -> bool:
        """Whether ``fact`` (see ``versions.FACTS``) is proven of the version these tables are."""
        return bool(self.version and self.version.facts.get(fact))

    def between(self, name: str, first: _dt.datetime | None = None, last: _dt.datetime | None = None) -> DataFrame:
        """Rows of a day-laid table whose timestamp lies in ``[first, last]``; other days are not read."""
        day, column = DAY_LAYOUT[name]
        rows = self.by_day.get(name, getattr(self, name))
        if first is not None:
            rows = rows.where(F.col(column) >= ntz(first))
            if name in self.by_day and day != column:
                rows = rows.where(F.col(day) >= F.lit(first.date()))
        if last is not None:
            rows = rows.where(F.col(column) <= ntz(last))
            if name in self.by_day and day != column:
                rows = rows.where(F.col(day) <= F.lit(last.date()))
        return rows.select(*TABLE_SCHEMAS[name].fieldNames())

    def on_days(self, name: str, days: Iterable[_dt.date | None]) -> DataFrame:
        """Rows of a day-laid table on the given days (None: rows without a timestamp)."""
        day, column = DAY_LAYOUT[name]
        rows = self.by_day.get(name, getattr(self, name))
        generated = name in self.by_day and day != column
        wanted = list(days)
        # Of a partition column too this expression prunes partitions.
        at = F.col(day) if name in self.by_day and day != column else F.col(column).cast("date")
        values = [F.lit(d) for d in wanted if d is not None]
        hit = at.isin(*values) if values else F.lit(False)
        if None in wanted:
            hit = F.coalesce(hit, F.lit(False)) | at.isNull()
        return rows.where(hit).select(*TABLE_SCHEMAS[name].fieldNames())


def day_of(name: str) -> Column:
    """The day that a row of a day-laid table belongs to."""
    return F.col(DAY_LAYOUT[name][1]).cast("date")


def published_versions(spark: SparkSession, root: str) -> list[str]:
    """Paths of the published versions under ``root``, oldest first; folders of
    writes that failed are not among them."""
    return [v.path for v in versions.versions(spark, root)]


def _stored_schema(name: str) -> StructType:
    """The schema of a table's files and partitions: with the generated day."""
    schema = TABLE_SCHEMAS[name]
    if DAY_LAYOUT.get(name, (None,))[0] == DAY:
        return StructType([*schema.fields, StructField(DAY, DateType())])
    return schema


def _plain_parts(spark: SparkSession, path: str) -> dict[str, Parts]:
    """Tables as plain ``<path>/<table>`` folders."""
    found = {}
    for name in TABLE_SCHEMAS:
        folder = versions.qualified(spark, f"{path}/{name}")
        by_day = name in DAY_LAYOUT and any(
            p.startswith(f"{DAY_LAYOUT[name][0]}=") for p in versions.partitions(spark, folder))
        found[name] = (Part(folder, by_day=by_day),)
    return found


def table_locations(spark: SparkSession, path: str) -> dict[str, Parts]:
    """Where each table lies: of the version that ``path`` names, of the newest
    version published under ``path``, or else as plain ``<path>/<table>`` folders."""
    version = versions.find(spark, path)
    return version.tables if version else _plain_parts(spark, path)


def read_parts(spark: SparkSession, schema: StructType, parts: Parts) -> DataFrame:
    """The rows of some folders: one scan a folder, each of its days that count only."""
    frames = [spark.read.schema(schema).option("basePath", p.folder).parquet(*p.paths())
              for p in parts if p.days is None or p.days]
    if not frames:
        return spark.createDataFrame([], schema)
    return functools.reduce(DataFrame.unionByName, [f.select(*schema.fieldNames()) for f in frames])


def read_tables(spark: SparkSession, path: str) -> Tables:
    """The ten tables at ``path`` (see :func:`table_locations`) with their declared schemas.

    Declaring the schema skips inference and makes column pruning, filter
    pushdown and (for day-partitioned tables) partition pruning reach the
    scan for each job. Columns come back in declared order.
    """
    version = versions.find(spark, path)
    where = version.tables if version else _plain_parts(spark, path)
    frames, by_day = {}, {}
    for name, schema in TABLE_SCHEMAS.items():
        laid = name in DAY_LAYOUT and all(p.by_day for p in where[name])
        stored = read_parts(spark, _stored_schema(name) if laid else schema, where[name])
        frames[name] = stored.select(*schema.fieldNames())
        if laid:
            by_day[name] = stored
    return Tables(**frames, version=version, by_day=by_day)


def write_table(frame: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write one table of a version as parquet; an existing path is an error.

    A partitioned table is rebalanced on its partition columns first (AQE
    sizes the write tasks and splits a large day), so each task writes a few
    large files of one day instead of every task writing a file for every day.
    """
    if partition_by:
        frame.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        frame.write.parquet(path)


def _write_part(frame: DataFrame, name: str, folder: str) -> Part:
    """Write the rows of a table, by day if it is laid out so."""
    if name not in DAY_LAYOUT:
        write_table(frame, folder)
        return Part(versions.qualified(frame.sparkSession, folder))
    day, column = DAY_LAYOUT[name]
    write_table(frame if day == column else frame.withColumn(day, day_of(name)), folder, [day])
    return Part(versions.qualified(frame.sparkSession, folder), by_day=True)


def prove_facts(detail: DataFrame, daily: DataFrame) -> dict[str, bool]:
    """Which facts hold of the roll-up tables. Keys are counted map-side first; nothing but one row is collected."""
    from worklens.operators.departments import detail_date_mismatch

    repeated = detail.groupBy("oid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    odd = detail_date_mismatch(detail, daily).limit(1).count()
    return {"unique_oid": not repeated, "dates_agree": not odd}


def write_version(tables: dict[str, DataFrame], root: str, version: str,
                  unchanged: dict[str, Parts] | None = None, parent: Version | None = None,
                  days: dict[str, list[_dt.date | None]] | None = None,
                  facts: dict[str, bool] | None = None) -> str:
    """Write the given tables as ``root/<version>/<table>`` and publish the version.

    ``unchanged`` says where the other tables lie. ``days`` names, for tables
    laid out by day, the days that changed: of such a table the frame holds
    the rows of those days only, and the other days stay where ``unchanged``
    has the table. ``parent`` is the version the tables were made from if it
    is one of this root; publishing fails with ``versions.StaleParent`` if it
    is not the newest (without one, the newest at the start of the write is
    meant). The folder of an existing version, published or not, is refused,
    so a failure half-way is never visible and never damages what is there
    (the original scripts ran their statements without a transaction).

    ``facts`` are carried over to the version if the caller knows that the
    change keeps them; else they are proven from the written roll-up tables.
    """
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    target = os.path.join(root, version)
    unchanged, days = unchanged or {}, days or {}
    missing = (set(TABLE_SCHEMAS) - set(tables) - set(unchanged)) | (set(days) - set(unchanged))
    if missing:
        raise ValueError(f"no table or location given for {sorted(missing)}")
    parent = parent or versions.newest(spark, root)
    versions.claim(spark, target)
    where = {}
    for name in TABLE_SCHEMAS:
        if name not in tables:
            where[name] = unchanged[name]
        elif name in days:
            if not all(p.by_day for p in unchanged[name]):
                raise ValueError(f"{name} is not laid out by day; write it whole")
            where[name] = unchanged[name]
            if days[name]:
                part = _write_part(tables[name], name, os.path.join(target, name))
                part = dataclasses.replace(part, days=tuple(versions.partitions(spark, part.folder)))
                where[name] = versions.with_days_replaced(
                    spark, unchanged[name], [d and d.isoformat() for d in days[name]], part)
        else:
            where[name] = (_write_part(tables[name], name, os.path.join(target, name)),)
    if facts is None:
        detail, daily = (read_parts(spark, TABLE_SCHEMAS[n], where[n]) for n in ("user_productivity_daily_detail", "user_productivity_daily"))
        facts = prove_facts(detail, daily)
    return versions.commit(spark, root, version, parent, where, facts) and target
