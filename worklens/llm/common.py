"""Helpers shared by the operators: tables, shared storage, word arrays."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.session import configure, ensure_checkpoint_dir

#: Words are maximal runs of bytes other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the folder all executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in storage that outlives any executor, and gives
    the optimizer the table's true size.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one operator, deleted once nothing reads them any more.

    A table may go when all that was made of it is itself staged: then no
    lineage leads back to it, whichever executors are lost.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(read)] = (read, path)
        return read

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            _, path = self.paths.pop(id(frame))
            path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def words_of(text: bytes | None) -> list[bytes]:
    """White-space words of one UTF-8 text, A-Z lower-cased."""
    return text.lower().split() if text else []


def raw_texts(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class WordArrays:
    """Many word lists as one array of word numbers.

    ``ids`` numbers the words of all lists one after another, ``start`` and
    ``length`` place each list in it, and ``hashes`` holds a 64-bit hash of
    each distinct word.
    """

    def __init__(self, lists):
        seen: dict[bytes, int] = {}
        lengths, parts = [], []
        for words in lists:
            lengths.append(len(words))
            parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)))
        self.words = list(seen)
        self.length = np.array(lengths, np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))

    def at(self) -> np.ndarray:
        """The list of each word."""
        return np.repeat(np.arange(len(self.length)), self.length)

    def windows(self, n: int, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of the ``n`` words from each position on (garbage where a list ends sooner)."""
        x = mix64(self.hashes ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1)))[self.ids]
        out = np.zeros(len(x), np.uint64)
        for j in range(min(n, len(x))):
            out[: len(x) - j] += x[j:] * np.uint64(pow(0xD1342543DE82EF95, j, 2**64))
        return mix64(out)

    def room(self) -> np.ndarray:
        """Words from each position to the end of its list."""
        return np.repeat(self.start + self.length, self.length) - np.arange(len(self.ids))
