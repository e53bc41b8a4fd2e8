"""Exact top-k inner-product search with a vector-approximation file.

Vectors and queries are cut into blocks of bounded size by a hash, and every
pair of a query block and a vector block is one task's work. A task quantises
its vectors to ``CELLS`` cells a dimension (the approximation file of the
block), scans the cells for an upper bound of every query's score, and then
reads exact vectors in the order of that bound until the k-th best score is at
least the next bound. A window keeps each query's best k of all blocks.

The query set grows with the table, so the work is (queries x vectors); each
task's memory is bounded by the two block sizes, and a block gives at most k
rows a query to the last step.

Vectors that are NULL or hold NULL or non-finite components, and rows without
vec_id, take no part. Shorter vectors count as padded with zeros. Rows that
share the query's vec_id are its own; equal vectors are ties that the smaller
vec_id wins. Queries without any candidate give no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklens.llm.common import table

TOP = 5
EVERY = 50
SCALE = 256
CELLS = 16
VECTOR_BLOCK = 32_768
QUERY_BLOCK = 2_048
#: Exact vectors read at once.
READ = 64

HITS = "query_id long, vec_id long, score long"


def matrix(table: pa.Table) -> np.ndarray:
    """The integer vectors of a block as float64 rows (exact below 2^53)."""
    column = table.column("v").combine_chunks()
    length = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(length), int(length.max(initial=0))))
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():]
    out[np.arange(out.shape[1]) < length[:, None]] = values[: length.sum()]
    return out


class ApproximationFile:
    """Cells of a block's vectors, with each cell's bounds a dimension."""

    def __init__(self, vectors: np.ndarray, cells: int = CELLS):
        edges = np.quantile(vectors, np.linspace(0, 1, cells + 1)[1:-1], axis=0, method="lower")
        dims = vectors.shape[1]
        self.codes = np.empty(vectors.shape, np.uint8)
        self.low, self.high = np.zeros((dims, cells)), np.zeros((dims, cells))
        for d in range(dims):
            codes = self.codes[:, d] = np.searchsorted(edges[:, d], vectors[:, d], side="right")
            self.low[d], self.high[d] = np.inf, -np.inf
            np.minimum.at(self.low[d], codes, vectors[:, d])
            np.maximum.at(self.high[d], codes, vectors[:, d])

    def upper_bounds(self, query: np.ndarray) -> np.ndarray:
        """At least the inner product of the query with each vector, from the cells alone."""
        with np.errstate(invalid="ignore"):
            best = np.maximum(query[:, None] * self.low, query[:, None] * self.high)
        best[~np.isfinite(self.low)] = 0  # cells without vectors
        bound = np.zeros(len(self.codes))
        for d in range(len(query)):
            bound += best[d][self.codes[:, d]]
        return bound


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; in Python integers where float64 would round."""
    most = np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(len(query), 1)
    if most < 2**53:
        return (vectors @ query).astype(np.int64)
    products = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors]
    return np.array([min(max(p, -(2**63)), 2**63 - 1) for p in products], np.int64)


def top_of_block(file: ApproximationFile, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int,
                 k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best vectors of a block, ties to smaller ids."""
    bound = file.upper_bounds(query)
    bound[ids == own] = -np.inf
    # Bounds are float sums: widen them by their rounding.
    bound += np.abs(bound).max(where=np.isfinite(bound), initial=0) * 1e-12 + 1e-9
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    todo = np.flatnonzero(np.isfinite(bound))
    step = READ
    while len(todo):
        if len(todo) > step:
            cut = np.argpartition(-bound[todo], step)
            read, todo = todo[cut[:step]], todo[cut[step:]]
        else:
            read, todo = todo, todo[:0]
        best_ids = np.concatenate([best_ids, ids[read]])
        best = np.concatenate([best, exact_scores(vectors[read], query)])
        order = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[order], best[order]
        if len(best) == k:
            todo = todo[bound[todo] >= best[-1]]
        step *= 4
    return best_ids, best


def search_block(k: int):
    def search(queries: pa.Table, block: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if queries.num_rows and block.num_rows:
            vectors, wanted = matrix(block), matrix(queries)
            dims = max(vectors.shape[1], wanted.shape[1])
            vectors, wanted = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (vectors, wanted))
            ids = block.column("vec_id").to_numpy()
            file = ApproximationFile(vectors)
            for own, query in zip(queries.column("vec_id").to_pylist(), wanted):
                found += [(own, int(i), int(s)) for i, s in zip(*top_of_block(file, vectors, ids, query, own, k))]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return search


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The k best (vec_id, v) rows of ``vectors`` for each (vec_id, v) of ``queries``: query_id, rank, vec_id, score."""
    blocks = max(1, -(-vectors.count() // VECTOR_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def block(n: int):
        return F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.withColumn("_q", block(query_blocks)).withColumn("_b", every(blocks))
    right = vectors.withColumn("_b", block(blocks)).withColumn("_q", every(query_blocks))
    hits = left.groupBy("_q", "_b").cogroup(right.groupBy("_q", "_b")).applyInArrow(search_block(k), HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): components x as floor(256 * x), usable rows only."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
        .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))
    )


def search_report(embeddings: DataFrame) -> DataFrame:
    vectors = integer_vectors(embeddings)
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0).distinct())


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_report(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM usable q JOIN usable c ON c.vec_id <> q.vec_id
    WHERE q.vec_id % {EVERY} = 0),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored)
SELECT * FROM ranked WHERE rank <= {TOP}"""
