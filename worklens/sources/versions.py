"""The version chain: what each published version consists of.

A version is one record in ``<root>/_log``: for every table the folders that
hold its rows, and of a folder laid out by day the days that still count
(:class:`Part`). A next version names its parent; tables, and days of a table,
that did not change stay in the folders where an earlier version wrote them.

Records are numbered. Publishing creates record ``n + 1`` exclusively, and only
if the parent is record ``n``: of two runs that started from one version
exactly one succeeds, and nobody sees half of a version, since the record is
created last and complete.

A record also holds what is proven of the version's rows (:data:`FACTS`).

The store must create a file name once: a local disk (hard links), or a file
system whose rename refuses an existing target, as HDFS does.
"""

from __future__ import annotations

import dataclasses
import json
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

LOG = "_log"
#: What can be proven of a version: no two detail rows share an oid; every
#: detail row has the date of its parent day row.
FACTS = ("unique_oid", "dates_agree")
#: Spark's folder name for the partition of a NULL day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class StaleParent(RuntimeError):
    """The version a run started from is no longer the newest."""


@dataclasses.dataclass(frozen=True)
class Part:
    """A folder of Parquet files; ``days`` names its day partitions that count, None is all of it.

    ``by_day`` says whether the folder is laid out by day at all.
    """

    folder: str
    days: tuple[str, ...] | None = None
    by_day: bool = False

    def paths(self) -> list[str]:
        return [self.folder] if self.days is None else [f"{self.folder}/{d}" for d in self.days]


Parts = tuple[Part, ...]


@dataclasses.dataclass(frozen=True)
class Version:
    root: str
    name: str
    sequence: int
    parent: str | None
    tables: dict[str, Parts]
    facts: dict[str, bool] = dataclasses.field(default_factory=dict)

    @property
    def path(self) -> str:
        return f"{self.root}/{self.name}"

    def to_json(self) -> str:
        return json.dumps({
            "version": self.name, "parent": self.parent, "facts": self.facts,
            "tables": {t: [dataclasses.asdict(p) for p in parts] for t, parts in self.tables.items()}})


def day_of(partition: str) -> str | None:
    """The calendar day (YYYY-MM-DD) of a partition folder's name; None for the NULL day."""
    value = partition.split("=", 1)[1]
    return None if value == NO_DAY else value[:10]


# Files of whatever store the root lies in.

def hadoop_path(spark: SparkSession, path: str):
    """(file system, qualified path)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop_path(spark, path)
    return fs.exists(where)


def qualified(spark: SparkSession, path: str) -> str:
    return hadoop_path(spark, path)[1].toString()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, where = hadoop_path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def partitions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the day partitions in a folder."""
    return [c for c in children(spark, folder) if "=" in c]


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = hadoop_path(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """Create a file with all its content, or raise FileExistsError and change nothing."""
    fs, where = hadoop_path(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getScheme() == "file":
            file = spark._jvm.java.io.File
            try:
                os_path = file(where.toUri().getPath()).toPath()
                spark._jvm.java.nio.file.Files.createLink(os_path, file(draft.toUri().getPath()).toPath())
            except Exception as error:
                if "FileAlreadyExists" in str(error):
                    raise FileExistsError(f"{path} exists") from None
                raise
        elif not fs.rename(draft, where):
            raise FileExistsError(f"{path} exists")
    finally:
        fs.delete(draft, False)


# The log.

def _record(root: str, sequence: int) -> str:
    return f"{root}/{LOG}/{sequence:020d}.json"


def _sequences(spark: SparkSession, root: str) -> list[int]:
    return [int(c.split(".")[0]) for c in children(spark, f"{root}/{LOG}") if c.endswith(".json") and c[0] != "."]


def _load(spark: SparkSession, root: str, sequence: int) -> Version:
    said = json.loads(read_text(spark, _record(root, sequence)))
    tables = {t: tuple(Part(p["folder"], None if p["days"] is None else tuple(p["days"]), p["by_day"]) for p in parts)
              for t, parts in said["tables"].items()}
    return Version(root, said["version"], sequence, said["parent"], tables, said["facts"])


def versions(spark: SparkSession, root: str) -> list[Version]:
    """The published versions under ``root``, oldest first."""
    root = qualified(spark, root)
    return [_load(spark, root, s) for s in _sequences(spark, root)]


def newest(spark: SparkSession, root: str) -> Version | None:
    root = qualified(spark, root)
    found = _sequences(spark, root)
    return _load(spark, root, found[-1]) if found else None


def find(spark: SparkSession, path: str) -> Version | None:
    """The newest version published under ``path``, or the version that ``path`` names."""
    if (version := newest(spark, path)) is not None:
        return version
    root, name = os.path.split(path.rstrip("/"))
    return next((v for v in versions(spark, root) if v.name == name), None) if root else None


def claim(spark: SparkSession, path: str) -> None:
    """Take the folder of a version that is to be written; an existing one is refused."""
    if exists(spark, path):
        raise FileExistsError(f"{path} exists; a version is written once, under a new name")
    fs, where = hadoop_path(spark, path)
    fs.mkdirs(where)
    create_once(spark, f"{path}/_WRITER", uuid.uuid4().hex)


def commit(spark: SparkSession, root: str, name: str, parent: Version | None, tables: dict[str, Parts],
           facts: dict[str, bool]) -> Version:
    """Publish a written version as the successor of ``parent`` (None: the first one of the root).

    Raises :class:`StaleParent`, with nothing published, if the newest record
    is another one, also if that happens between the look and the creation.
    """
    root = qualified(spark, root)
    top = newest(spark, root)
    if (top and top.sequence) != (parent and parent.sequence):
        raise StaleParent(f"{name} starts from {parent and parent.name}, but {top and top.name} is the newest under {root}")
    version = Version(root, name, parent.sequence + 1 if parent else 0, parent.name if parent else None, tables, facts)
    fs, where = hadoop_path(spark, f"{root}/{LOG}")
    fs.mkdirs(where)
    try:
        create_once(spark, _record(root, version.sequence), version.to_json())
    except FileExistsError:
        raise StaleParent(f"another run published record {version.sequence} of {root} first") from None
    return version


def with_days_replaced(spark: SparkSession, parts: Parts, days: Iterable[str | None], written: Part) -> Parts:
    """``parts`` without the partitions of ``days``, and with what was written for them (perhaps no rows)."""
    gone, kept = set(days), []
    for part in parts:
        names = partitions(spark, part.folder) if part.days is None else part.days
        left = tuple(n for n in names if day_of(n) not in gone)
        if left:
            kept.append(dataclasses.replace(part, days=left))
    return (*kept, written) if written.days else tuple(kept) or (written,)
