"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order (NULL last) weigh 3, 1, 2, 3, 1, 2, ... and share
150 % of all words by weight. A target stops at twice its source's words; the
excess is shared among the others by weight until no target is above.

Inside a source a document's expected copies grow with its size:
``level * size ** SIZE_POWER``, at most ``MOST_COPIES``, with one level a source
such that the expected words are its target. The whole copies of that number
are certain. Its fraction f is the inclusion probability of one more copy, which
Pareto order sampling draws: documents are ranked by (u/(1-u)) / (f/(1-f)) with
u a hash of (doc_id, text), and the first ranks are taken. The sample's fixed
size is counted in words, as the target is: ranks are taken until their words
add up to what the certain copies leave of it, to the nearest document.

The level of a source follows from its numbers of documents per size (one task
sees a source's distinct sizes, never its documents). The cut of each source is
found without sorting a source: words are summed by (source, rank bucket), a
running sum over the buckets finds the bucket that holds the cut, and only that
bucket's documents are ordered. Plan rows are one per source; the join to the
documents is salted, so a source with a third of all rows has no task of its own
(and Spark broadcasts the plan when its written size is below the session's
threshold).

NULL texts and texts without words have size 0 and are not taken, targets of
empty sources are 0. Rows that repeat doc_id and text have one rank and are taken together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklens.llm.common import stage, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: Inclusion grows with this power of a document's size (0: all documents of a source alike).
SIZE_POWER = 0.5
SEED = 77
#: Rank buckets; one bucket of a source is what a single task orders.
BUCKETS = 1 << 16
SALTS = 32


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) from a hash of the columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def source_key(source: Column) -> Column:
    """The source as a join key in code-point order, NULL last (no text starts with a 2)."""
    return F.when(source.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), source))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size) -> (key, source_size, target): water filling over one row per source."""
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = (
        sizes
        .withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key")))
        .withColumn("_weight", F.element_at(weights, (F.pmod(F.col("_n") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
        .withColumn("_most", F.col("source_size") * float(MOST_COPIES))
        .withColumn("_fill", F.col("_most") / F.col("_weight"))
    )
    # In order of the level at which a source is full: the first source that is
    # not full when the rest is shared by weight gives the common level.
    below = Window.partitionBy(F.lit(0)).orderBy("_fill", "key").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(F.lit(0)).orderBy("_fill", "key").rowsBetween(0, Window.unboundedFollowing)
    leveled = (
        ranked
        .withColumn("_all", F.sum("source_size").over(everything) * SHARE)
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_most").over(below), F.lit(0.0)))
                    / F.sum("_weight").over(rest))
        .withColumn("_common", F.first(F.when(F.col("_level") <= F.col("_fill"), F.col("_level")), ignorenulls=True).over(
            Window.partitionBy(F.lit(0)).orderBy("_fill", "key").rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("_most"), F.coalesce(F.col("_weight") * F.col("_common"), F.col("_most")))
    return leveled.select("key", "source_size", target.alias("target"))


def expected_copies() -> Column:
    """Copies that a document is expected to give, from its size and its source's level."""
    free = F.col("level") * F.pow(F.col("size"), F.lit(SIZE_POWER))
    # (Full up to the last digits of the level.)
    return F.when(free < MOST_COPIES * (1 - 1e-9), free).when(free.isNotNull(), F.lit(float(MOST_COPIES)))


def with_copies(rows: DataFrame) -> DataFrame:
    """(size, level, ...) with the certain copies and the inclusion probability of one more."""
    expected = F.coalesce(expected_copies(), F.lit(0.0))
    return rows.withColumn("whole", F.floor(expected)).withColumn("fraction", expected - F.floor(expected))


def source_levels(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, size, n) and targets -> (key, level, rest): the level at which expected words are the target, and the words
    that certain copies leave of it.

    From the largest size on, sizes that would exceed ``MOST_COPIES`` are full; the first size that is not full when
    the rest of the target is spread over it and all smaller ones gives the level.
    """
    larger = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(0, Window.unboundedFollowing)
    words, power = F.col("n") * F.col("size"), F.pow(F.col("size"), F.lit(SIZE_POWER))
    each = sizes.filter("size > 0").join(targets.select("key", "target"), "key")
    leveled = each.withColumn(
        "_level", (F.col("target") - MOST_COPIES * F.coalesce(F.sum(words).over(larger), F.lit(0))) / F.sum(words * power).over(others))
    level = F.max_by(F.col("_level"), F.when(F.col("_level") * power <= MOST_COPIES * (1 + 1e-12), F.col("size")))
    # No such size: the target is all there is, and even a text of one word is full.
    levels = leveled.groupBy("key").agg(F.greatest(F.coalesce(level, F.lit(float(MOST_COPIES))), F.lit(0.0)).alias("level"))
    certain = with_copies(each.join(levels, "key")).groupBy("key", "level").agg(
        (F.first("target") - F.sum(F.col("whole") * words)).alias("rest"))
    return certain.select("key", "level", "rest")


def mixing_plan(sized: DataFrame) -> DataFrame:
    """(key, size, u) per document -> one row per source: size, target, level and cut rank.

    A document is taken once more if its rank is at or below ``cut`` (NULL: none is).
    """
    sizes = stage(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-numbers")
    totals = sizes.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = stage(source_targets(totals), "mixing-targets")
    plan = stage(targets.join(source_levels(sizes, targets), "key", "left").withColumnRenamed("rest", "_rest"), "mixing-plan")
    ranked = with_copies(with_plan(sized, plan.select("key", "level"))).filter("fraction > 0").withColumn("rank", rank())
    bucket = F.floor(F.col("rank") / (F.col("rank") + 1) * BUCKETS)
    ranked = ranked.withColumn("_bucket", bucket)
    sums = ranked.groupBy("key", "_bucket").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut_bucket = (
        sums.withColumn("_end", F.sum("_words").over(upto))
        .join(plan.select("key", "_rest"), "key")
        .filter((F.col("_end") >= F.col("_rest")) & (F.col("_end") - F.col("_words") < F.col("_rest")))
        .select("key", "_bucket", "_rest", (F.col("_end") - F.col("_words")).alias("_before"))
    )
    at_cut = salted(ranked, cut_bucket, ["key", "_bucket"])
    by_rank = at_cut.groupBy("key", "rank", "_rest", "_before").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    # Up to the rank that reaches the rest, or to the one before it if that is nearer.
    near = (
        by_rank.withColumn("_end", F.col("_before") + F.sum("_words").over(upto))
        .filter(F.col("_end") - F.col("_words") < F.col("_rest"))
        .withColumn("_over", F.col("_end") - F.col("_rest"))
        .filter((F.col("_over") <= 0) | (F.col("_over") <= F.col("_rest") - (F.col("_end") - F.col("_words"))))
    )
    # Without such a rank the cut lies at the end of the bucket before.
    cuts = (
        cut_bucket.join(near.groupBy("key").agg(F.max("rank").alias("_rank")), "key", "left")
        .select("key", F.coalesce("_rank", edge(F.col("_bucket"))).alias("cut"))
    )
    return stage(plan.drop("_rest").join(cuts, "key", "left"), "mixing-cuts")


def edge(bucket: Column) -> Column:
    """A rank below all of a bucket and at or above all of the one before."""
    share = bucket / F.lit(float(BUCKETS))
    return share / (1 - share) * (1 - 1e-12) - 1e-300


def rank() -> Column:
    """Random odds by inclusion odds; NULL where nothing is left to sample."""
    f = F.col("fraction")
    return F.try_divide(F.col("u") * (1 - f), (1 - F.col("u")) * f)


def salted(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which each key's rows are spread over ``SALTS`` join keys."""
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    return (
        rows.withColumn("_salt", F.pmod(F.hash("u"), F.lit(SALTS)))
        .join(few.withColumn("_salt", F.explode(salts)), [*keys, "_salt"])
        .drop("_salt")
    )


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return salted(rows, plan, ["key"])


def sized_documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({
        "key": source_key(F.col("source")),
        "size": word_count(F.col("text")),
        "u": uniform(F.col("doc_id"), F.crc32(text.cast("binary")), F.octet_length(text)),
    })


def apply_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with source_size, target, copies (0, 1 or 2) and taken words."""
    more = F.coalesce(F.col("_rank") <= F.col("cut"), F.lit(False))
    return (
        with_copies(with_plan(sized, plan)).withColumn("_rank", rank())
        .withColumn("copies", (F.col("whole") + more.cast("long")).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_rank", "whole", "fraction", "level", "cut")
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns as they were.

    The input's columns travel as one struct, so none can clash with the mix's own.
    """
    columns = docs.columns
    held = sized_documents(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
                                       "doc_id", "text", "source")).drop("doc_id", "text", "source")
    plan = mixing_plan(stage(held.select("key", "size", "u"), "mixing-sizes"))
    return (
        apply_plan(held, plan).filter("copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("_row.*")
    )


def mixing_report(docs: DataFrame) -> DataFrame:
    sized = stage(sized_documents(docs).select("doc_id", "key", "size", "u"), "mixing-sizes")
    plan = mixing_plan(sized.select("key", "size", "u"))
    return apply_plan(sized, plan).select("doc_id", "size", "source_size", "target", "taken")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(table(spark, sf_dir, "documents"))
