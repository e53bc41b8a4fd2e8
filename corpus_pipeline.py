"""The training-text pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``:

1. quality classifier: documents whose score is below 0.5 go;
2. n-gram Jaccard join (five-word shingles, similarity 0.8): of each group of
   linked documents the one with the smallest doc_id stays, as one row;
   documents without words link with nothing and stay;
3. benchmark decontamination: contaminated documents go;
4. mixing sources to target weights: documents are repeated or left out;
5. sharding: every row with row_number, shard and slot.

SQL cannot express the learned classifier, so there is no oracle statement;
the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from worklens.llm.common import Scratch, table
from worklens.llm.decontamination import as_rows, decontaminate
from worklens.llm.mixing import mix_documents
from worklens.llm.ngram_join import Rule, one_of_each_group
from worklens.llm.quality import fit, keep_classified
from worklens.llm.sharding import assign_shards

#: Near duplicates of the pipeline: five-word shingles, similarity 0.8 or more.
NEAR = Rule(words=5, num=8, den=10)
LEAST_SCORE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_classified(docs, fit(docs, table(spark, sf_dir, "labels")), LEAST_SCORE)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs, NEAR)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(as_rows(docs), table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return assign_shards(docs)


STAGES = [
    ("quality", keep_quality),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark), table(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        docs = scratch.stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
