"""Filter interaction audit: what five filters remove in every order.

A document fails A with under ``MIN_WORDS`` words, B when its distinct words are
under ``DISTINCT_PERCENT`` of its words, C when its letters A-Z exceed
``UPPER_PERCENT`` of its characters, D when it holds one of ``MARKS``, and E when
its text equals that of any smaller doc_id.

E is an existential self-join: documents left-semi-joined, on the text's hash,
the exact text and a smaller doc_id, to the distinct texts that more than one
doc_id has (with the smallest one; combined where they arise, so copies of a
text meet once a task). A text held by more than its share of the rows is hot:
its copies are dealt over as many salts as its rows fill shares, and only its one
row on the other side is repeated. With P shuffle partitions at most P texts
hold more than 1/P of the rows, so at most P hashes are broadcast.

The ids that fail E are united with all documents' other failures, and bits are
combined per (doc_id, text hash, part). What is left of a part is the number of
documents per bit combination, 32 at most, with their good and toxic ones: a
document stays behind a set of filters if it fails none of them, so every order,
step and Shapley sum follows from those counts, one part at a time.

NULL texts count as empty (and are copies of one another). A NULL doc_id is
neither smaller nor larger than another, so its row never fails E. Rows that
repeat a doc_id are documents of their own; they are no smaller than each other.
A NULL source is part ''. A document is good (toxic) if any of its labels has
quality (toxic) 1; NULL labels count as none. Of odd tables other columns are
not read. An empty table has no parts and gives an empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.common import shuffle_partitions, stage, table
from worklens.plans.distributed import join_spreading_key

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
MARKS = r"[#$%&*|]"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
SETS = 1 << len(FILTERS)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text, digest) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def own_failures(keyed: DataFrame) -> DataFrame:
    """``keyed`` without its text, with the bits of the filters that look at one text: A to D."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    measured = keyed.withColumn("_words", words).select(
        "doc_id", "part", "digest",
        F.size("_words").cast("long").alias("n"), F.size(F.array_distinct("_words")).cast("long").alias("distinct"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("upper"), F.length("text").cast("long").alias("points"),
        F.col("text").rlike(MARKS).alias("marked"))

    def bit(name: str, fails: Column) -> Column:
        return F.when(fails, BIT[name]).otherwise(0)

    return measured.select(
        "doc_id", "part", "digest",
        (bit("A", F.col("n") < MIN_WORDS)
         + bit("B", F.col("distinct") * 100 < F.col("n") * DISTINCT_PERCENT)
         + bit("C", F.col("upper") * 100 > F.col("points") * UPPER_PERCENT)
         + bit("D", F.col("marked"))).alias("bits"))


def copies(keyed: DataFrame, rows: int) -> DataFrame:
    """The rows of ``keyed``, without their text, whose text a smaller doc_id has too (filter E)."""
    shares = shuffle_partitions(keyed.sparkSession)
    share = max(1, rows // shares)
    firsts = stage(
        keyed.groupBy("digest", "text")
        .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("_rows"))
        .filter("first_id < _last").drop("_last"), "audit-copies")
    hot = firsts.filter(F.col("_rows") > share).groupBy("digest").agg(
        F.ceil(F.sum("_rows") / share).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    smaller = firsts.join(F.broadcast(hot), "digest", "left").select(
        "digest", F.col("text").alias("_text"), "first_id", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    each = keyed.join(F.broadcast(hot), "digest", "left").withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "part"), salts).cast("int")).alias("d")
    smaller = smaller.alias("s")
    same = ((F.col("d.digest") == F.col("s.digest")) & (F.col("d._salt") == F.col("s._salt"))
            & (F.col("d.text") == F.col("s._text")) & (F.col("s.first_id") < F.col("d.doc_id")))
    return each.join(smaller, same, "left_semi").select("doc_id", "part", "digest")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and combination of failed filters."""
    keyed = _keyed(docs)
    own = own_failures(keyed).withColumn("rows", F.lit(1).cast("long"))
    again = copies(keyed, docs.count()).select(
        "doc_id", "part", "digest", F.lit(BIT["E"]).alias("bits"), F.lit(0).cast("long").alias("rows"))
    # Written, as a sketch of the ids looks for hot ones before they are joined to the labels.
    masks = stage(own.unionByName(again).groupBy("doc_id", "part", "digest").agg(
        F.bit_or("bits").alias("mask"), F.sum("rows").alias("n")), "audit-masks")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("_good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("_toxic"))
    marked = join_spreading_key(masks, marks, "doc_id", ["digest", "part"])
    return marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("_good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("_toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def _steps() -> str:
    """All steps of all orders as SQL structs: order, step, the filter's bit and the bits of those before it."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            out.append(f"struct('{''.join(order)}', {step}, {BIT[name]}, {before})")
            before |= BIT[name]
    return f"array({', '.join(out)})"


def audit(combos: DataFrame) -> DataFrame:
    """The report of every part, order and step from :func:`combinations`."""
    def left(count: str) -> Column:
        """Documents that fail none of a set of filters, for every set."""
        return F.expr(f"transform(sequence(0, {SETS - 1}), s -> aggregate("
                      f"filter(combos, c -> (c.mask & s) = 0), 0L, (a, c) -> a + c.{count}))")

    # A filter comes behind a given set of k others in k! (4 - k)! orders.
    shapley = F.expr(
        f"transform(sequence(0, {len(FILTERS) - 1}), f -> aggregate(filter(sequence(0, {SETS - 1}), "
        "s -> (s & shiftleft(1, f)) = 0), 0L, (a, s) -> a + element_at(array(24L, 6L, 4L, 6L, 24L), bit_count(s) + 1)"
        " * (get(n, s) - get(n, s | shiftleft(1, f)))))")
    parts = (
        combos.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("combos"))
        .select("part", left("n").alias("n"), left("good").alias("good"), left("toxic").alias("toxic"),
                F.expr(f"transform(sequence(0, {SETS - 1}), s -> aggregate(filter(combos, c -> c.mask = s), 0L, "
                       "(a, c) -> a + c.n))").alias("exactly"))
        .withColumn("shapley", shapley)
    )
    steps = parts.select("*", F.expr(f"inline({_steps()})").alias("filter_order", "step", "bit", "before"))
    return steps.selectExpr(
        "part", "filter_order", "step",
        "get(n, before | bit) AS kept",
        "get(n, before) - get(n, before | bit) AS removed",
        "(get(n, 0) - get(n, bit)) - (get(n, before) - get(n, before | bit)) AS redundant",
        "get(exactly, bit) AS unique_fails",
        "get(good, before) - get(good, before | bit) AS good_lost",
        "get(toxic, before) - get(toxic, before | bit) AS toxic_lost",
        "get(shapley, bit_count(bit - 1)) AS shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(combinations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = """
WITH flags AS (
    SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents),
firsts AS (SELECT body, min(doc_id) AS first_id FROM flags GROUP BY body),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           [len(words) < 50,
            100 * len(list_distinct(words)) < 65 * len(words),
            100 * len(regexp_extract_all(body, '[A-Z]')) > 5 * length(body),
            regexp_matches(body, '[#$%&*|]'),
            coalesce(flags.doc_id > first_id, false)] AS fail
    FROM flags JOIN firsts USING (body) LEFT JOIN marks ON marks.doc_id = flags.doc_id),
combos AS (SELECT part, fail, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, fail),
one AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
    SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM one a, one b, one c, one d, one e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
    SELECT list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order,
           step, o[step] AS f, o[1:step - 1] AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
told AS (
    SELECT part, filter_order, step, f, n, good, toxic, fail[f] AS failing,
           len(list_filter(before, lambda x: fail[x])) > 0 AS gone, len(list_filter(fail, lambda x: x)) AS fails
    FROM steps, combos),
counted AS (
    SELECT part, filter_order, step, f,
           sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN failing AND fails = 1 THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost
    FROM told GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted"""
