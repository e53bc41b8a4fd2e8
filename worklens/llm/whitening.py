"""Embedding whitening with distributed block matrices.

Every entry c of a usable vector becomes the integer x = floor(SCALE * c) +
OFFSET. The fit list holds each distinct x vector once: n vectors with exact
per-dimension sums S. Rows are centred in integers first, x - floor(S/n), then by
the remaining fraction, so no digits are lost to the offset. Centred rows are
indexed by their place in a written table and dealt into the blocks of an MLlib
BlockMatrix:

1. transpose(fit) x fit, with the inner dimension split over all tasks, is the
   scatter matrix, whose d x d sums are the only thing the driver gets;
2. a local eigh of scatter / n gives the components;
3. rows x whitening matrix (one block matrix of d x k) projects all rows, whose
   results come back by their index.

The fit matrix holds the first row of each distinct vector and zeros elsewhere;
zero rows add nothing to a scatter. Distinct vectors are found by a grouping that
combines copies where they lie, and every join is on the unique row index, so a
vector that a third of all rows share makes no hot task. The whitened fit list is
multiplied with its own transpose the same way, and ``identity_error`` compares
its covariance with the identity. Blocks hold at most ``BLOCK_ENTRIES`` numbers;
the driver sees one key a block, about ``BLOCKS_A_TASK`` for each shuffle
partition.

Rows take no part whose vector is NULL, holds NULL or non-finite entries, is
empty, or has an entry beyond +-``LARGEST`` (its x would not fit). Where lengths
differ, the most frequent one (of equals the longer) counts and rows of other
lengths take no part. Repeated rows and vec_ids are rows of their own, a NULL
vec_id is kept. Vectors of under k dimensions have as many components. A
component without variance (eigenvalue up to ``FLAT`` of the greatest) has
whitened NULL and no say in ``identity_error``; with no variance at all
``explained`` is NULL too. A deviation beyond a long is NULL. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklens.llm.common import shuffle_partitions, stage, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
LARGEST = 2.0**40
FLAT = 1e-12
BLOCK_ENTRIES, BLOCK_COLUMNS, BLOCKS_A_TASK = 1 << 22, 512, 4


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    entries = F.col("_e")
    sound = F.forall(entries, lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)))  # NaN is beyond any number
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("_e")).filter(
        F.col("_e").isNotNull() & (F.size("_e") > 0) & sound)
    length = rows.groupBy(F.size("_e").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("d")).limit(1).select("d").scalar()
    return rows.filter(F.size("_e") == length).select(
        "vec_id", F.transform("_e", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``index`` = 0..n-1, their place in a written table.

    The table fixes each row's partition and sequence, so a task that runs
    again sees the same numbers; one offset a partition is broadcast.
    """
    placed = stage(rows.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()),
                   "whitening-rows")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first")).select(
        "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(offsets), "_part").withColumn("index", F.col("_seq") + F.col("_shift")).drop(
        "_part", "_seq", "_shift")


@dataclasses.dataclass(frozen=True)
class Centre:
    """Size and exact sums of the fit list."""

    n: int
    sums: tuple[int, ...]

    def _floors(self) -> Column:
        return F.lit([s // self.n for s in self.sums])

    def centred(self, x: Column) -> Column:
        """x - S/n as doubles, subtracted as integers first."""
        rest = F.lit([(s % self.n) / self.n for s in self.sums])
        return F.zip_with(F.zip_with(x, self._floors(), lambda a, m: (a - m).cast("double")), rest, lambda a, r: a - r)

    def deviation(self, x: Column) -> Column:
        """sum of (n x - S)^2 in exact long arithmetic; NULL beyond a long."""
        rest = F.lit([s % self.n for s in self.sums])
        numerators = F.zip_with(F.zip_with(x, self._floors(), lambda a, m: F.try_multiply(a - m, F.lit(self.n))),
                                rest, lambda a, r: F.try_subtract(a, r))
        return F.aggregate(numerators, F.lit(0).cast("long"), lambda t, a: F.try_add(t, F.try_multiply(a, a)))


def centre_of(fit: DataFrame) -> Centre:
    """Count and sums of (index, x), d numbers."""
    sums = fit.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).orderBy("j").collect()
    return Centre(sums[0]["n"] if sums else 0, tuple(r["s"] for r in sums))


def blocks_of(rows: DataFrame, values: Column, n_rows: int, width: int) -> BlockMatrix:
    """The block matrix whose row ``index`` holds ``values``; rows that are not there are zeros."""
    columns = min(width, BLOCK_COLUMNS)
    tasks = shuffle_partitions(rows.sparkSession)
    height = min(max(256, math.ceil(n_rows / (BLOCKS_A_TASK * tasks))), max(1, BLOCK_ENTRIES // columns))
    vectors = callMLlibFunc("createIndexedRowMatrix", _mllib(rows.select("index", array_to_vector(values).alias("vector"))),
                            n_rows, width)
    return IndexedRowMatrix(vectors).toBlockMatrix(height, columns)


def _mllib(rows: DataFrame) -> DataFrame:
    """The vector column as MLlib's older vector type, converted in the JVM."""
    from pyspark.mllib.util import MLUtils

    return MLUtils.convertVectorColumnsFromML(rows, "vector")


def scatter(matrix: BlockMatrix, tasks: int) -> np.ndarray:
    """transpose(matrix) x matrix; row blocks are dealt over ``tasks`` inner splits, each adds up d x d numbers."""
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, tasks)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(spark: SparkSession, matrix: BlockMatrix, weights: np.ndarray) -> BlockMatrix:
    """matrix x weights; the weights have a block for each column block of the matrix."""
    step = matrix.colsPerBlock
    parts = [((i // step, 0), Matrices.dense(*part.shape, part.ravel(order="F")))
             for i in range(0, len(weights), step) for part in [weights[i:i + step]]]
    return matrix.multiply(BlockMatrix(spark.sparkContext.parallelize(parts), step, weights.shape[1], *weights.shape))


@dataclasses.dataclass(frozen=True)
class Whitening:
    """Components of the fit list: unit vectors (columns), eigenvalues and the trace of the covariance."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @staticmethod
    def of(centre: Centre, scattered: np.ndarray, k: int) -> Whitening:
        covariance = scattered / centre.n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        falling = np.argsort(-values, kind="stable")[:k]
        return Whitening(centre, vectors[:, falling], values[falling], float(np.trace(covariance)))

    @property
    def steep(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > FLAT * max(self.values.max(initial=0.0), 0.0)

    def matrix(self) -> np.ndarray:
        scale = np.zeros(len(self.values))
        scale[self.steep] = 1 / np.sqrt(self.values[self.steep])
        return self.vectors * scale

    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]

    def error(self, whitened_scatter: np.ndarray) -> float | None:
        """Largest entry of the whitened covariance minus the identity, over the components with variance."""
        kept = np.flatnonzero(self.steep)
        if not len(kept):
            return None
        return float(np.abs(whitened_scatter[np.ix_(kept, kept)] / self.centre.n - np.eye(len(kept))).max())


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """((vec_id, deviation, whitened: array of k), the components, identity error) of the usable rows."""
    spark = embeddings.sparkSession
    rows = indexed(usable(embeddings))
    fit = stage(rows.groupBy("x").agg(F.min("index").alias("index")), "whitening-fit")
    centre = centre_of(fit)
    if not centre.n:
        return rows.select("vec_id", F.lit(None).cast("long").alias("deviation"),
                           F.lit(None).cast("array<double>").alias("whitened")), None, None
    n_rows, width, tasks = rows.count(), len(centre.sums), shuffle_partitions(spark)
    fitted = blocks_of(fit, centre.centred(F.col("x")), n_rows, width)
    model = Whitening.of(centre, scatter(fitted, tasks), k)
    weights = model.matrix()
    # The whitened list is centred too, as a covariance is; its mean is that of the centred rows, about 1e-16.
    error = model.error(scatter(projected(spark, fitted, weights), tasks))
    every = projected(spark, blocks_of(rows, centre.centred(F.col("x")), n_rows, width), weights)
    values = callMLlibFunc("getIndexedRows", every.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    steep = F.lit([bool(s) for s in model.steep])
    whitened = F.zip_with(vector_to_array("vector"), steep, lambda w, s: F.when(s, w))
    return (
        rows.select("index", "vec_id", centre.deviation(F.col("x")).alias("deviation"))
        .join(values.select("index", whitened.alias("whitened")), "index").drop("index"), model, error)


def whitening_report(embeddings: DataFrame) -> DataFrame:
    rows, model, error = whiten(embeddings)
    explained = F.array(*[F.lit(v) for v in (model.explained() if model else [])]).cast("array<double>")
    return rows.select(
        "vec_id", F.posexplode("whitened").alias("_at", "whitened"), "deviation").select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.centre.n if model else 0).cast("long").alias("n"),
        "deviation", "whitened", F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(table(spark, sf_dir, "embeddings"))
