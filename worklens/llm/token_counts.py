"""Token counts through a digest cache.

A text's count is stored under (digest of the text, digest of the tokenizer):
SHA-256 of the UTF-8 text (NULL counts as the empty text; nothing else is
normalised, since any change to a text may change its tokens) and SHA-256 of
the tokenizer file with the library's version. ``count_tokens`` joins the
distinct text digests of a table to the cache, encodes only distinct misses,
appends their counts to the cache and reads all counts from it.

The cache is a Parquet table in shared storage to which every call appends a
folder in one commit; a call that dies leaves no rows, and two calls that
encode the same text store the same count. Equal texts meet pre-aggregated, so
a text with a third of all rows moves once a task. The tokenizer file travels
to the tasks as one string, at most ``MAX_TOKENIZER_BYTES``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.common import shared_path, table

TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENIZER_BYTES = 64 << 20
LIMIT = 512
#: Texts longer than this many bytes are encoded one at a time.
BATCH_BYTES = 1 << 20
CACHE_SCHEMA = "text_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_file(path: str) -> tuple[str, str]:
    """The tokenizer's content and its version digest."""
    import tokenizers

    size = os.path.getsize(path)
    if size > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} has {size} bytes; the tasks get at most {MAX_TOKENIZER_BYTES}")
    with open(path, encoding="utf-8") as file:
        content = file.read()
    return content, hashlib.sha256(f"tokenizers {tokenizers.__version__}\n{content}".encode()).hexdigest()


def encoder(content: str, version: str):
    """mapInArrow function: (text_digest, text) -> rows of the cache."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = None
        for batch in batches:
            if model is None:
                model = Tokenizer.from_str(content)
                model.no_truncation()
                model.no_padding()
            counts, part, size = [], [], 0
            for text in batch.column("text").to_pylist():
                part.append(text or "")
                size += len(part[-1])
                if size >= BATCH_BYTES:
                    counts += [len(e) for e in model.encode_batch_fast(part, add_special_tokens=False)]
                    part, size = [], 0
            counts += [len(e) for e in model.encode_batch_fast(part, add_special_tokens=False)] if part else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                ["text_digest", "tokenizer_digest", "n_tokens"])

    return encode


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(text_digest, n_tokens) of one tokenizer version, one row a digest."""
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return stored.filter(F.col("tokenizer_digest") == version).groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` (without its text) with ``_n_tokens``; misses are appended to ``cache``.

    ``cache`` is a folder URI; a missing one starts empty.
    """
    spark = docs.sparkSession
    content, version = tokenizer_file(tokenizer)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.withColumn("text_digest", F.unhex(F.sha2(body.cast("binary"), 256)))
    misses = (
        keyed.select("text_digest", body.alias("text"))
        .groupBy("text_digest").agg(F.first("text").alias("text"))
        .join(read_cache(spark, cache, version), "text_digest", "left_anti")
    )
    misses.mapInArrow(encoder(content, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version).withColumnRenamed("n_tokens", "_n_tokens")
    return keyed.drop(text).join(counts, "text_digest").drop("text_digest")


def op7_token_counts(spark: SparkSession, sf_dir: str, cache: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Counts of all documents; the cache of one run, unless a standing one is named."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return token_report(table(spark, sf_dir, "documents"), cache or shared_path(spark, "token-cache"), tokenizer)


def token_report(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = count_tokens(docs.select("doc_id", "text", n_bytes.alias("n_bytes")), cache, tokenizer)
    return counted.select("doc_id", "n_bytes", F.col("_n_tokens").alias("n_tokens"),
                          (F.col("_n_tokens") > LIMIT).alias("over_limit"))
