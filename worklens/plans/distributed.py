"""Distributed building blocks the jobs share.

* :func:`materialize` - a lineage cut in shared storage.
* :func:`hot_keys` - the keys that hold more than a task's share of the rows.
* :func:`join_spreading_key` - an equi-join whose left keys may be hot or NULL.
* :func:`global_ordinal` - 1..n numbering in a global sort order without a
  single-partition window.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from worklens.session import ensure_checkpoint_dir

def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the session's shared folder and read it back.

    The files outlive any executor (unlike a cache or a local checkpoint), the
    rows are computed once, and the reader knows the table's true size.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Items a sketch tracks for each share of the rows: its error stays well under one share.
TRACKED_PER_SHARE = 8


def _key_hash(rows: DataFrame, key: list[str]) -> Column:
    """A hash that equal keys share (of collated strings, which hash by their bytes, the folded text)."""
    def canonical(name: str) -> Column:
        kind = rows.schema[name].dataType
        collated = isinstance(kind, StringType) and kind.collation != "UTF8_BINARY"
        # a final sigma lowers by its place in the word, but collates as any other
        return F.translate(F.lower(F.rtrim(F.col(name).cast("string"))), "ς", "σ") if collated else F.col(name)

    return F.xxhash64(*[canonical(k) for k in key])


@dataclasses.dataclass(frozen=True)
class HotKeys:
    """Hashes of the keys that hold more than a share of some rows, by the salts they get (powers of two).

    The driver holds them: with P shuffle partitions under 1.5 P numbers.
    """

    by_salts: tuple[tuple[int, tuple[int, ...]], ...] = ()

    @staticmethod
    def of(counts: Iterable[tuple[int, int]], n: int, shares: int) -> HotKeys:
        """From (key hash, rows) of the largest keys of ``n`` rows."""
        groups: dict[int, list[int]] = {}
        for key_hash, rows in counts:
            if rows * shares > n:
                # as many salts as the rows fill shares, rounded up
                groups.setdefault(1 << (-(-rows * shares // n) - 1).bit_length(), []).append(key_hash)
        return HotKeys(tuple((salts, tuple(sorted(hashes))) for salts, hashes in sorted(groups.items()) if salts > 1))

    def salts(self, key_hash: str) -> Column:
        """Salts of the key with that hash, as an expression over a column."""
        cases = "".join(f" WHEN {key_hash} IN ({', '.join(f'{h}L' for h in hashes)}) THEN {salts}L"
                        for salts, hashes in self.by_salts)
        return F.expr(f"CASE{cases} ELSE 1L END") if cases else F.lit(1).cast("bigint")


#: No key is known to be hot: adaptive execution alone splits large partitions.
NO_HOT_KEYS = HotKeys()


def _shares(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(rows: DataFrame, key: str | list[str]) -> HotKeys:
    """The keys that hold more than one share of ``rows``, a share being the rows
    of a shuffle partition if all had as many.

    One job over the key columns of ``rows``, in which each task keeps a
    mergeable heavy-hitter sketch of its keys' hashes and passes on one row.
    Keys near a share may be listed as well, within the sketch's error of a
    sixth of a share. Two keys of one hash share their salts; NULL keys do not
    count.
    """
    key = [key] if isinstance(key, str) else key
    # The sketch tracks a million items and lists 100,000 of them at most.
    shares = min(_shares(rows.sparkSession), 50_000)
    present = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).select(_key_hash(rows, key).alias("_key_hash"))
    found = present.agg(
        F.expr(f"approx_top_k(_key_hash, {2 * shares}, {max(64, TRACKED_PER_SHARE * shares)})").alias("top"),
        F.count(F.lit(1)).alias("n")).first()
    return HotKeys.of([(r["item"], r["count"]) for r in found["top"] or ()], found["n"], shares)


def hot_keys_of_counts(counts: DataFrame, key: str, rows: str) -> HotKeys:
    """:func:`hot_keys` of rows that are already counted: ``counts`` has one or more rows a key, ``rows`` its count."""
    shares = _shares(counts.sparkSession)
    per_key = counts.where(F.col(key).isNotNull()).groupBy(_key_hash(counts, [key]).alias("_key_hash")).agg(
        F.sum(rows).alias("_rows"))
    n = per_key.agg(F.sum("_rows").alias("n")).first()["n"] or 0
    found = per_key.where(F.col("_rows") * shares > n).collect() if n else []
    return HotKeys.of([(r["_key_hash"], r["_rows"]) for r in found], n, shares)


def join_spreading_key(left: DataFrame, right: DataFrame, key: str | list[str], spread_by: list[str],
                       how: str = "left", hot: HotKeys | None = None) -> DataFrame:
    """``left.join(right, key, how)`` for a left key with hot values or NULLs.

    Rows of a hot left key (``hot``; without it :func:`hot_keys` of ``left``
    runs first) are dealt over its salts by a hash of ``spread_by``
    (deterministic, so a retried task salts identically), and the right rows of
    that key are repeated for each salt; all other right rows stay single. A
    NULL key can match nothing, so its salt is the full 64-bit hash and its rows
    spread over all partitions. ``right`` must carry ``key`` and no other column
    of ``left``. The salts are expressions, so Spark's size estimates stay those
    of the two sides, and its byte threshold decides what is broadcast. Without
    hot keys the salt of a row is its key's own hash: a constant one would be
    folded into a filter, and the rows dealt by the key alone again.
    """
    key = [key] if isinstance(key, str) else key
    hot = hot_keys(left, key) if hot is None else hot
    spread = F.xxhash64(*spread_by)
    absent = F.expr(" OR ".join(f"`{k}` IS NULL" for k in key))
    if hot == NO_HOT_KEYS:
        dealt = left.withColumn("_salt", F.when(absent, spread).otherwise(_key_hash(left, key)))
        repeated = right.withColumn("_salt", _key_hash(right, key))
    else:
        salts = hot.salts("_key_hash")
        dealt = left.withColumn("_key_hash", _key_hash(left, key)).withColumn(
            "_salt", F.when(absent, spread).otherwise(F.pmod(spread, salts))).drop("_key_hash")
        repeated = right.withColumn("_key_hash", _key_hash(right, key)).withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("_key_hash")
    return dealt.join(repeated, [*key, "_salt"], how).drop("_salt")


def left_join_spreading_nulls(left: DataFrame, right: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    """``left.join(right, key, 'left')`` where only the NULL key is hot."""
    return join_spreading_key(left, right, key, spread_by, "left", NO_HOT_KEYS)


def global_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """``df`` with ``name`` = 1..n in ``order``, computed without one task
    seeing all rows.

    The rows are range-partitioned and sorted, tagged with their partition
    and a within-partition sequence, and written to shared storage, so the
    layout is fixed even if executors are lost and tasks rerun. Each
    partition's start offset is a running sum over one row per partition -
    a table bounded by the partition count, broadcast back to the rows.
    """
    tagged = materialize(
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id()),
        "ordinal",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select("_part", "_first", "_offset")
    )
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_seq") - F.col("_first") + 1)
        .drop("_part", "_seq", "_first", "_offset")
    )
