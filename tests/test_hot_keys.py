"""Hot join keys: found by a sketch, salted by their share, everything else left single."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from worklens.plans.distributed import (
    NO_HOT_KEYS, hot_keys, hot_keys_of_counts, join_spreading_key, left_join_spreading_nulls,
)


@pytest.fixture()
def sixteen(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield 16
    spark.conf.set("spark.sql.shuffle.partitions", old)


def salts(spark, hot, keys):
    """Salts of the keys that get more than one."""
    hashed = spark.createDataFrame([(k,) for k in keys], "k bigint").withColumn("_key_hash", F.xxhash64("k"))
    return {r["k"]: r["s"] for r in hashed.withColumn("s", hot.salts("_key_hash")).where("s > 1").collect()}


def skewed(spark, n=20_000):
    """Key 0 has 90 % of the rows with a key, 1 has 4 %, the others are rare; a fifth of all rows has no key."""
    return spark.range(n, numPartitions=7).select(
        "id", F.when(F.col("id") % 5 == 4, F.lit(None)).when(F.col("id") % 100 < 90, 0).when(F.col("id") % 100 < 94, 1)
        .otherwise(F.col("id")).cast("bigint").alias("k"))


def test_a_key_gets_salts_by_its_share(spark, sixteen):
    # nine tenths of the rows are 14.4 of 16 shares, rounded up to a power of two
    assert salts(spark, hot_keys(skewed(spark), "k"), range(2000)) == {0: 16}
    # Four keys of a quarter each get a quarter of the salts each.
    even = spark.range(4000).select((F.col("id") % 4).alias("k"))
    assert salts(spark, hot_keys(even, "k"), range(9)) == {0: 4, 1: 4, 2: 4, 3: 4}
    assert hot_keys(spark.range(4000).select(F.col("id").alias("k")), "k") == NO_HOT_KEYS
    assert hot_keys(spark.range(0).select(F.col("id").alias("k")), "k") == NO_HOT_KEYS


def test_counted_rows_give_the_same_keys(spark, sixteen):
    rows = skewed(spark)
    counts = rows.groupBy("k", (F.col("id") % 3).alias("third")).agg(F.count(F.lit(1)).alias("n"))
    assert hot_keys_of_counts(counts, "k", "n") == hot_keys(rows, "k")
    assert hot_keys_of_counts(counts.where("false"), "k", "n") == NO_HOT_KEYS


def test_many_partitions_and_many_keys(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3000")
    try:
        rows = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("k"))
        found = hot_keys(rows, "k")
        assert salts(spark, found, [7, 8, 10]) == {7: 1024}
        assert sum(len(hashes) for _, hashes in found.by_salts) <= 4500
        every = spark.range(300_000).select((F.col("id") % 1500).alias("k"))  # all keys hold two shares
        found = hot_keys(every, "k")
        assert salts(spark, found, range(1500)) == dict.fromkeys(range(1500), 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_hot_key_fills_the_partitions_and_others_are_not_repeated(spark, sixteen):
    left = skewed(spark)
    right = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    spark.conf.set(keys[0], "-1")
    spark.conf.set(keys[1], "false")
    try:
        joined = join_spreading_key(left, right, "k", ["id"])
        tasks = joined.where("k = 0").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= 8 and max(r["count"] for r in tasks) < 0.4 * 14_400
        nulls = joined.where("k is null").groupBy(F.spark_partition_id()).count().collect()
        assert len(nulls) == sixteen
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        for k in keys:
            spark.conf.unset(k)
    want = left.join(right, "k", "left")
    assert joined.exceptAll(want).count() == 0 and want.exceptAll(joined).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_several_key_columns(spark, how):
    left = spark.range(600).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("a"),
                                   F.when(F.col("id") % 3 > 0, F.lit("x")).alias("b"))
    right = spark.createDataFrame([(0, "x", 1), (1, "x", 2), (1, "x", 3), (0, "y", 4), (None, "x", 5)], "a bigint, b string, v int")
    got, want = join_spreading_key(left, right, ["a", "b"], ["id"], how), left.join(right, ["a", "b"], how)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("join", [
    lambda left, right: join_spreading_key(left, right, "k", ["id"], "left", NO_HOT_KEYS),
    lambda left, right: left_join_spreading_nulls(left, right, "k", ["id"])])
def test_rows_without_a_key_are_spread_where_no_key_is_known_to_be_hot(spark, sixteen, join):
    left = spark.range(8000, numPartitions=7).select(
        "id", F.when(F.col("id") % 5 == 4, F.col("id") % 1000).cast("bigint").alias("k"))
    right = spark.createDataFrame([*((k, k * 10) for k in range(900)), (None, 5)], "k bigint, v bigint")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    spark.conf.set(keys[0], "-1")
    spark.conf.set(keys[1], "false")
    try:
        joined = join(left, right)
        nulls = [r["count"] for r in joined.where("k is null").groupBy(F.spark_partition_id()).count().collect()]
        # 6,400 rows have no key; a salt that folds into a constant deals them all to one task
        assert len(nulls) == sixteen and max(nulls) < 800
    finally:
        for k in keys:
            spark.conf.unset(k)
    want = left.join(right, "k", "left")
    assert joined.exceptAll(want).count() == 0 and want.exceptAll(joined).count() == 0


def test_collated_keys_that_lower_differently_still_meet(spark):
    left = spark.createDataFrame([(1, "ΟΔΟΣ "), (2, "οδοσ"), (3, "x"), (4, None)], "id bigint, k string COLLATE UTF8_LCASE_RTRIM")
    right = spark.createDataFrame([("οδοσ", 7), ("X  ", 8)], "k string COLLATE UTF8_LCASE_RTRIM, v int")
    got = join_spreading_key(left, right, "k", ["id"], "left", NO_HOT_KEYS)
    assert {r["id"]: r["v"] for r in got.collect()} == {1: 7, 2: 7, 3: 8, 4: None}
