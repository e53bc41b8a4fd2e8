"""Sharding by a keyed permutation of global row numbers.

Every row gets a global row number (:mod:`worklens.llm.rows`); a balanced
Feistel network over the smallest even number of bits that holds all row
numbers permutes them, walking the cycle until the value is again below the
number of rows. Shard and slot follow from the permuted number alone, and the
inverse finds the row of a given shard and slot, so the shuffle can be
reproduced or looked up without any stored table.

The law is ``rows``: shards differ by one row at most. NULL texts count as
empty, equal rows take different slots, an empty table gives an empty result;
other columns of the input are kept whatever their name, but ``row_number``,
``shard`` and ``slot`` are replaced; their types must be sortable (no maps).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.common import mix64, table
from worklens.llm.rows import number_rows

SHARDS = 8
SEED = 20240601
ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    return mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _network(x: np.ndarray, half: int, seed: int, back: bool) -> np.ndarray:
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    for key in _keys(seed)[::-1] if back else _keys(seed):
        if back:
            left, right = right ^ (mix64(left ^ key) & mask), left
        else:
            left, right = right, left ^ (mix64(right ^ key) & mask)
    return (left << bits) | right


def permute(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permuted values of ``x`` among 0..n-1; ``back`` undoes it."""
    half = _half_bits(n)
    out = _network(np.asarray(x, np.uint64), half, seed, back)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], half, seed, back)
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The global row number that lies in ``slot`` of ``shard``."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


PLACED = ("row_number", "shard", "slot")


def assign_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with row_number, shard and slot (columns of these names are replaced)."""

    @F.pandas_udf("long")
    def place(row: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), int(total.iloc[0]), seed)) if len(row) else row

    kept = [F.col(f"_row.`{c}`") for c in df.columns if c not in PLACED]
    return (
        number_rows(df, "row_number", "_total")
        .withColumn("_place", place("row_number", "_total"))
        .select(*kept, "row_number", F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
                F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"))
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


def shard_report(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(sized).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number")
