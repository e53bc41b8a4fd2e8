"""Kept day sums: reports over a version read the days that changed, not all detail.

The per-user reports start from the same sums: measures per (date, user,
resource), which merge over days, resources and users. A :class:`DaySums`
store keeps them as a table laid out by day, next to the tables or anywhere
else, with a record of the files each day was summed from. The files of a
version never change, so comparing that record with the version's own
(:mod:`worklens.sources.versions`) tells which days to sum again: a day whose
files are others, or that is new. Days the version no longer has are left out.

The sums are kept before the catalogue filter, so a change of the catalogue
needs no new sums. Work hours and weekdays are baked into them; stores of
other parameters are told apart by name.

Records are numbered and created once, as versions are: of two runs that
refresh a store at the same time one publishes, and the other reads that record
and sums what is still missing. A lost run leaves files that no record names.
"""

from __future__ import annotations

import dataclasses
import datetime as _dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.functions import NOCASE, Names, ntz
from worklens.operators import reports, rollup
from worklens.sources import versions
from worklens.sources.tables import Tables, read_parts, write_table
from worklens.sources.versions import Part

DETAIL = "user_productivity_daily_detail"
KEYS = ["date", "system_user", "productivity_base"]


def measures(params: reports.ReportParams) -> list[Column]:
    """The sums that all per-user reports with these work hours and weekdays start from."""
    return [*rollup.work_hour_measures(params.work_hours, params.day_weekdays), *reports.resource_measures(params),
            *rollup.plain_type_sums("_plain")]


def _name(params: reports.ReportParams) -> str:
    hours, days, top = params.work_hours, params.day_weekdays, params.top_weekdays
    return f"hours-{hours[0]}-{hours[1]}-days-{days[0]}-{days[1]}-top-{top[0]}-{top[1]}"


def day_files(spark: SparkSession, tables: Tables) -> dict[str | None, tuple[str, ...]]:
    """The partition folders of each day of the version's detail; one listing a folder at most."""
    if tables.version is None or DETAIL not in tables.by_day:
        raise ValueError("day sums are kept of published versions whose detail is laid out by day")
    found: dict[str | None, list[str]] = {}
    for part in tables.version.tables[DETAIL]:
        for name in versions.partitions(spark, part.folder) if part.days is None else part.days:
            found.setdefault(versions.day_of(name), []).append(f"{part.folder}/{name}")
    return {day: tuple(sorted(paths)) for day, paths in found.items()}


@dataclasses.dataclass(frozen=True)
class Record:
    """What has been summed: of a day and the detail files it was summed from, the
    folder and partitions that hold the sums (None: no rows)."""

    sequence: int
    sums: dict[tuple[str | None, tuple[str, ...]], tuple[str, tuple[str, ...]] | None]

    def parts(self, days: dict[str | None, tuple[str, ...]]) -> tuple[Part, ...]:
        """The folders of some days' sums, one part a folder."""
        folders: dict[str, list[str]] = {}
        for day in days.items():
            if (kept := self.sums[day]) is not None:
                folders.setdefault(kept[0], []).extend(kept[1])
        return tuple(Part(folder, tuple(sorted(names)), True) for folder, names in sorted(folders.items()))

    def missing(self, days: dict[str | None, tuple[str, ...]]) -> list[str | None]:
        return sorted((day for day, files in days.items() if (day, files) not in self.sums), key=lambda d: d or "")


class DaySums:
    """The store under ``root`` for one set of report parameters."""

    def __init__(self, spark: SparkSession, root: str, params: reports.ReportParams):
        self.spark, self.params = spark, params
        self.root = versions.qualified(spark, f"{root}/{_name(params)}")

    def _latest(self) -> Record:
        records = [c for c in versions.children(self.spark, f"{self.root}/_log") if c.endswith(".json") and c[0] != "."]
        if not records:
            return Record(-1, {})
        said = json.loads(versions.read_text(self.spark, f"{self.root}/_log/{records[-1]}"))
        return Record(int(records[-1].split(".")[0]), {
            (day, tuple(files)): kept and (kept[0], tuple(kept[1])) for day, files, kept in said})

    def _publish(self, record: Record) -> None:
        fs, where = versions.hadoop_path(self.spark, f"{self.root}/_log")
        fs.mkdirs(where)
        versions.create_once(self.spark, f"{self.root}/_log/{record.sequence:020d}.json",
                             json.dumps([[day, files, kept] for (day, files), kept in record.sums.items()]))

    def stale_days(self, tables: Tables) -> list[str | None]:
        """The days of the version whose files have not been summed."""
        return self._latest().missing(day_files(self.spark, tables))

    def refresh(self, tables: Tables) -> DataFrame:
        """Sum the stale days of the version and give the sums of all its days.

        Only the stale days' partitions of the detail are read, and only their
        sums are written. Sums of other versions' files stay on record.
        """
        files = day_files(self.spark, tables)
        while True:
            before = self._latest()
            stale = before.missing(files)
            if not stale:
                return self._read(before, files)
            folder = f"{self.root}/run-{uuid.uuid4().hex}"
            rows = tables.on_days(DETAIL, [d and _dt.date.fromisoformat(d) for d in stale])
            write_table(rollup.day_resource_measures(rows, measures(self.params)), folder, ["date"])
            written: dict[str | None, list[str]] = {}
            for name in versions.partitions(self.spark, folder):
                written.setdefault(versions.day_of(name), []).append(name)
            summed = {(d, files[d]): (folder, tuple(written[d])) if d in written else None for d in stale}
            record = Record(before.sequence + 1, {**before.sums, **summed})
            try:
                self._publish(record)
            except FileExistsError:
                continue  # another run published first; look again at what is missing
            return self._read(record, files)

    def _read(self, record: Record, days) -> DataFrame:
        schema = rollup.day_resource_measures(self._empty_detail(), measures(self.params)).schema
        return read_parts(self.spark, schema, record.parts(days))

    def _empty_detail(self) -> DataFrame:
        from worklens.sources.schemas import TABLE_SCHEMAS

        return self.spark.createDataFrame([], TABLE_SCHEMAS[DETAIL])


def user_day_totals(sums: DataFrame, base: DataFrame, names: Names = NOCASE) -> DataFrame:
    """:func:`rollup.user_day_totals` from kept sums."""
    types = ["sum_productive", "sum_distracting", "sum_neutral", "sum_undefined"]
    plain = sums.drop(*types).withColumnsRenamed({f"{t}_plain": t for t in types})
    return rollup.day_totals(rollup.reportable(plain, base, names))


def user_day_work_hours(sums: DataFrame, base: DataFrame, params: reports.ReportParams) -> DataFrame:
    """:func:`rollup.user_day_work_hours` from kept sums."""
    days = sums.where(F.col("date").between(ntz(params.day_from), ntz(params.day_until)))
    return rollup.work_hour_days(rollup.reportable(days, base, params.names))
