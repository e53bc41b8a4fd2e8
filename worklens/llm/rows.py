"""Global row numbers that depend on the rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm.common import shuffle_partitions

#: Hash ranges for each shuffle partition, whose row counts are summed to offsets: that many rows are broadcast.
RANGES_A_PARTITION = 4
#: Copies of one row are expanded in steps of so many.
STEP = 10_000


def number_rows(df: DataFrame, name: str = "row_number", total: str = "total_rows") -> DataFrame:
    """Every row of ``df`` as the struct ``_row`` with ``name`` = 0..n-1 in the order of a hash of the whole row, and
    ``total`` = n.

    Rows fall into hash ranges, some for each shuffle partition; a window
    numbers the rows of each, and a running sum over the ranges' counts gives
    the offsets. The numbers do not depend on files, partitions, ranges or
    retries. Equal rows are counted before any shuffle and take consecutive
    numbers, so a row that repeats often makes no hot task. Columns may have
    any name; their types must be sortable.
    """
    bits = max(1, (RANGES_A_PARTITION * shuffle_partitions(df.sparkSession) - 1).bit_length())
    distinct = (
        df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
        .groupBy("_row").agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_hash", F.xxhash64("_row"))
        .withColumn("_range", F.shiftrightunsigned("_hash", 64 - bits))
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        distinct.groupBy("_range").agg(F.sum("_copies").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn(total, F.sum("_rows").over(Window.orderBy("_range").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))
        .drop("_rows")
    )
    within = Window.partitionBy("_range").orderBy("_hash", "_row")
    first = F.col("_offset") + F.sum("_copies").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_copies")
    return (
        distinct.join(F.broadcast(offsets), "_range")
        .withColumn("_first", first)
        .withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(STEP).cast("long"))))
        .withColumn("_at", F.explode(F.sequence(F.col("_step"), F.least(F.col("_step") + STEP, F.col("_copies")) - 1)))
        .select("_row", (F.col("_first") + F.col("_at")).alias(name), total)
    )
