"""Documents in units, and the exchange of sorted number lists between units and buckets.

Operators on all words of all documents work in rounds. The documents are
dealt once into units by a hash of the whole row (``by_unit``); a unit is a
bounded share of the rows, and its shuffle is reused by every round. A unit
reduces its words to sorted distinct keys, sends each key to the bucket its
value belongs to, and the bucket answers every unit. A key that most documents
share is sent once a unit, so no bucket grows with a key's frequency.

There are as many buckets as the session has shuffle partitions, and twice as
many units: both grow with the cluster's setting, and so with the data it is sized for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import shuffle_partitions

#: Units a shuffle partition: a task holds one unit's word arrays at a time.
UNITS_PER_PARTITION = 2
#: doc_id of rows without one: they come after all others.
NO_ID = np.iinfo(np.int64).max


def by_unit(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and the unit ``u``, shuffled by it."""
    n = UNITS_PER_PARTITION * shuffle_partitions(docs.sparkSession)
    picked = docs.select(*columns)
    return picked.withColumn("u", F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")).repartition(n, "u")


def ordered(unit: pa.Table) -> pa.Table:
    """A unit's rows in an order that does not depend on how they arrived."""
    return unit.sort_by([(name, "ascending") for name in unit.column_names])


def ids_of(unit: pa.Table) -> np.ndarray:
    return unit.column("doc_id").fill_null(int(NO_ID)).to_numpy().astype(np.int64)


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned integers as compressed byte planes; ``rising`` ones as differences."""
    x = np.asarray(values).astype(np.uint64)
    if rising and len(x):
        x[1:] -= x[:-1].copy()
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(packed: bytes, rising: bool = False) -> np.ndarray:
    width, size = packed[0], int.from_bytes(packed[1:9], "little")
    planes = np.frombuffer(pa.decompress(packed[9:], size, "zstd", asbytes=True) if size else b"", np.uint8)
    x = np.zeros((size // width, 8), np.uint8)
    x[:, :width] = planes.reshape(width, -1).T
    x = x.reshape(-1).view(np.uint64)
    return np.cumsum(x, dtype=np.uint64) if rising else x


def pack_bits(bits: np.ndarray) -> bytes:
    return len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()


def unpack_bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8, offset=8), count=int.from_bytes(packed[:8], "little")).astype(bool)


def bucket_slices(bucket_of: np.ndarray, buckets: int) -> list[slice]:
    """Where each bucket's entries lie in an array sorted by bucket."""
    edges = np.searchsorted(bucket_of, np.arange(buckets + 1))
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


#: Arrow's types for the column types of the schemas that tasks return.
ARROW_TYPES = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(),
    "array<struct<start:int,end:int>>": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
}


def arrow_table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows as an Arrow table of a DDL schema ("name type, name type")."""
    fields = [column.split() for column in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, ARROW_TYPES[kind]) for c, (_, kind) in zip(columns, fields)],
                    names=[name for name, _ in fields])
