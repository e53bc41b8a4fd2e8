"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. ``with_statistics`` computes the statistics of every whole text with
   DataFrame functions only.
2. ``fit`` grows a random forest over the statistics of a bounded sample of
   labelled documents, reads every path from a root to a node as a conjunction
   of threshold conditions, and fits lasso logistic weights to the rules;
   rules with weight 0 are dropped.
3. ``RuleEnsemble.score`` compiles the rules that are left to one Spark column
   expression, so scoring is a projection without shuffle or Python.

The sample holds at most ``MAX_FIT_ROWS`` labelled documents, chosen by a hash
of doc_id; its ids are broadcast (16 bytes a row by construction) and its
statistics are what the trees see. Every other document is only read.

NULL and empty texts have all statistics 0 and get a score like any other
text. Labels that are NULL or neither 0 nor 1 are ignored, several labels of a
document count as their mean rounded up at one half. Without labels of both
classes the score is their mean, or 0.5 without any.
"""

from __future__ import annotations

import dataclasses
import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.common import stage, table

MAX_FIT_ROWS = 20_000
TREES = 16
DEPTH = 3
LASSO = 0.002
STEPS = 40
SEED = 11
FOLDS, HELD_OUT_FOLD = 3, 1


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``_stats`` of doubles (columns of ``docs`` must not start with an underscore but ``_row``)."""
    t = F.col("_text")

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern))

    base = docs.withColumn("_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    base = base.withColumn("_words", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    base = base.withColumn("_lines", F.filter(F.split("_text", r"[\n\r]+"), lambda x: x != ""))
    base = base.withColumns({
        "_chars": F.length("_text"),
        "_n": F.size("_words"),
        "_nl": F.size("_lines"),
        "_distinct": F.size(F.array_distinct("_words")),
        "_distinct_lines": F.size(F.array_distinct("_lines")),
        "_longest_word": F.coalesce(F.array_max(F.transform("_words", F.length)), F.lit(0)),
        # A word that equals the one before it.
        "_twice": F.size(F.filter(F.zip_with(F.col("_words"), F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))),
                                             lambda a, b: a == b), lambda same: same)),
        "_upper": count("[A-Z]"),
        "_digits": count("[0-9]"),
        "_stops": count("[.,;:?]"),
        "_marks": count(r"[!#$%&*@^~|\\<>{}\[\]=+_/]"),
        "_runs": count(r"([!#$%&*])\1+"),
        "_plain": count("[a-z]"),
    })
    stats = {
        "chars": F.log1p(F.col("_chars").cast("double")),
        "words": F.log1p(F.col("_n").cast("double")),
        "lines": F.log1p(F.col("_nl").cast("double")),
        "word_length": _share(F.col("_chars"), F.col("_n")),
        "longest_word": F.col("_longest_word").cast("double"),
        "distinct_words": _share(F.col("_distinct"), F.col("_n")),
        "distinct_per_root": _share(F.col("_distinct"), F.sqrt(F.col("_n").cast("double"))),
        "distinct_lines": _share(F.col("_distinct_lines"), F.col("_nl")),
        "line_length": _share(F.col("_n"), F.col("_nl")),
        "repeated_next": _share(F.col("_twice"), F.col("_n")),
        "upper": _share(F.col("_upper"), F.col("_chars")),
        "digits": _share(F.col("_digits"), F.col("_chars")),
        "stops": _share(F.col("_stops"), F.col("_n")),
        "marks": _share(F.col("_marks"), F.col("_chars")),
        "mark_runs": _share(F.col("_runs"), F.col("_n")),
        "plain": _share(F.col("_plain"), F.col("_chars")),
    }
    out = base.withColumn("_stats", F.struct(*[c.alias(n) for n, c in stats.items()]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "_stats")


@dataclasses.dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is above, threshold), all of which must hold, and a weight."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self) -> str:
        """The conjunction as a SQL condition over a ``_stats`` column."""
        return " AND ".join(f"_stats.{name} {'>' if above else '<='} {at!r}D" for name, above, at in self.conditions)


@dataclasses.dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """Probability of label 1 over a ``_stats`` column, as one compiled expression."""
        terms = [f"IF({r.holds()}, {r.weight!r}D, 0D)" for r in self.rules]
        return F.expr(f"1D / (1D + exp(-({' + '.join([f'{self.intercept!r}D', *terms])})))")


# Lines of a printed tree: the test that holds in a branch.
BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)$")


def tree_paths(printed: str, names: list[str]) -> set[tuple]:
    """Every path from a root to a node below it in printed trees, as sorted conditions."""
    found: set[tuple] = set()
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in printed.splitlines():
        if test := BRANCH.match(line):
            depth, feature, sign, at = test.groups()
            path = [p for p in path if p[0] < len(depth)]
            path.append((len(depth), (names[int(feature)], sign == ">", float(at))))
            found.add(tuple(sorted(condition for _, condition in path)))
        elif line.lstrip().startswith("Tree "):
            path = []
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """Statistics and label of at most ``max_rows`` documents that are not held out."""
    ids = (
        labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.round(F.avg("quality")).cast("double").alias("label"))
        .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(max_rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sample = with_statistics(found).select("doc_id", "label", "_stats")
    # One task and one order, so that the trees' draws repeat; the rows are bounded.
    return stage(sample.repartition(1).sortWithinPartitions("doc_id"), "quality-sample")


def _vectors(sample: DataFrame, columns: list[str]) -> DataFrame:
    return sample.select("label", array_to_vector(F.expr(f"array({', '.join(columns)})")).alias("x"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> RuleEnsemble:
    sample = labelled_sample(docs, labels, max_rows)
    names = sample.schema["_stats"].dataType.names
    seen = sample.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean")).first()
    mean = min(max(seen["mean"], 0.001), 0.999) if seen["n"] else 0.5
    constant = RuleEnsemble(math.log(mean / (1 - mean)), ())
    if not seen["n"] or seen["mean"] in (0.0, 1.0):
        return constant
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH,
                                    featureSubsetStrategy="0.6", subsamplingRate=0.7, minInstancesPerNode=5,
                                    seed=SEED).fit(_vectors(sample, [f"_stats.{n}" for n in names]))
    paths = sorted(tree_paths(forest.toDebugString, names))
    if not paths:  # no statistic tells the classes apart
        return constant
    rules = [Rule(p) for p in paths]
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=LASSO,
                               maxIter=STEPS, standardization=False).fit(
        _vectors(sample, [f"IF({r.holds()}, 1D, 0D)" for r in rules]))
    weights = lasso.coefficients.toArray()
    kept = tuple(dataclasses.replace(r, weight=float(w)) for r, w in zip(rules, weights) if w)
    return RuleEnsemble(float(lasso.intercept), kept)


def classify(docs: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """Every row of ``docs`` as the struct ``_row``, whatever its columns are called, with its ``_score``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("text"))
    return with_statistics(rows).select("_row", model.score().alias("_score"))


def keep_classified(docs: DataFrame, model: RuleEnsemble, least: float) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more."""
    # A filter moves through no projection that numbers its rows: so the score
    # is computed once, in the projection, not inlined in the filter for each
    # statistic that it names.
    scored = classify(docs, model).withColumn("_at", F.monotonically_increasing_id())
    return scored.filter((F.col("_score") >= least) & (F.col("_at") >= 0)).select("_row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = classify(docs.select("doc_id", "text"), fit(docs, labels))
    doc_id = F.col("_row.doc_id")
    return scored.select(doc_id, held_out(doc_id).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= 0.5).cast("int").alias("predicted"))
