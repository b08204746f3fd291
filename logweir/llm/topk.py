"""Exact top-k by inner product: columnar branch-and-bound.

Candidates lie in vertical layout, one dimension after the other. A block of queries accumulates partial
products over blocks of dimensions; after each, candidates whose partial product plus the product of the
remaining norms (the mass that the dimensions ahead can add) is below the query's k-th score so far are
compacted away. Queries and candidates meet in blocks of stated size, so no task's data grow with the input.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id.
Shorter vectors count as padded with zeros. Rows that share a query's id count as its own row; a query
repeated in equal rows gives one list. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm.common import small_batches

#: Queries and candidates in a block, candidates taken at a time within one, dimensions in a step.
QUERIES, CANDIDATES, STRIP, DIMENSIONS = 512, 8192, 2048, 16


def best(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of each query's k best among candidates; `columns` is dimensions by candidates. Integers in, exact integers out."""
    exact = np.float32 if (np.abs(queries).max(initial=0) * float(np.abs(columns).max(initial=0)) * max(1, len(columns))) < 2**24 else np.float64 if (np.abs(queries).max(initial=0) * float(np.abs(columns).max(initial=0)) * max(1, len(columns))) < 2**53 else np.int64
    q = queries.astype(exact)
    rest_q = _rest(queries.astype(np.float64).T)
    order = np.argsort(ids, kind="stable")  # by id: of equal scores the first kept is the smaller
    columns, ids = columns[:, order], ids[order]
    top_s = np.full((len(q), 0), 0, np.int64)
    top_i = np.full((len(q), 0), 0, np.int64)
    for a in range(0, len(ids), STRIP):
        x, xi = columns[:, a : a + STRIP], ids[a : a + STRIP]
        rest_x = _rest(x.astype(np.float64))
        floor = top_s[:, k - 1].astype(np.float64) if top_s.shape[1] >= k else None
        alive = np.arange(len(xi))
        total = np.zeros((len(q), len(alive)), exact)
        for d in range(0, len(x), DIMENSIONS):
            total += q[:, d : d + DIMENSIONS] @ x[d : d + DIMENSIONS, alive].astype(exact)
            nxt = min(d + DIMENSIONS, len(x))
            if floor is not None and nxt < len(x):
                # + 1e-6: the norms are rounded; a bound must not fall short
                may = (total + (rest_q[nxt][:, None] * rest_x[nxt][alive][None, :]) * (1 + 1e-9) + 1e-6 > floor[:, None]).any(0)
                if may.mean() < 0.75:
                    alive, total = alive[may], total[:, may]
            if not len(alive):
                break
        if not len(alive):
            continue
        s = np.concatenate([top_s, np.where(xi[alive][None, :] == query_ids[:, None], -(2**62), total.astype(np.int64))], 1)
        i = np.concatenate([top_i, np.broadcast_to(xi[alive], (len(q), len(alive)))], 1)
        # Earlier strips hold smaller ids, so a stable sort by score alone keeps ties in order of id.
        if s.shape[1] > 4 * k:
            kth = -np.partition(-s, k - 1, 1)[:, k - 1 : k]
            rows = []
            for r in range(len(q)):
                at = np.flatnonzero(s[r] >= kth[r])
                rows.append(at[np.argsort(-s[r, at], kind="stable")[:k]])
            pick = np.stack(rows)
        else:
            pick = np.argsort(-s, 1, kind="stable")[:, :k]
        top_s, top_i = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    row, at = np.nonzero(top_s > -(2**62))
    return row, top_i[row, at], top_s[row, at]


def _rest(columns: np.ndarray) -> np.ndarray:
    """Norm of what lies from each dimension on, one row more than there are dimensions."""
    squares = np.zeros((len(columns) + 1, columns.shape[1]))
    squares[:-1] = np.cumsum((columns**2)[::-1], 0)[::-1]
    return np.sqrt(squares)


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """One row a block: ids and a dimension-major matrix as bytes."""

    def run(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        n = np.diff(v.offsets.to_numpy())
        wide = np.zeros((len(n), int(n.max(initial=0))), np.int64)
        wide[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = v.flatten().to_numpy()
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.abs(wide).max(initial=0) <= np.iinfo(t).max)
        return pa.table({"block": table.column("block")[:1], "ids": pa.array([table.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()), "matrix": pa.array([wide.T.astype(kind).tobytes()], pa.binary()), "dims": pa.array([wide.shape[1]], pa.int32())})

    return rows.select(F.col(block).alias("block"), "id", "v").groupBy("block").applyInArrow(run, "block int, ids binary, matrix binary, dims int")


def _unpack(ids: bytes, matrix: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    width = len(matrix) // max(1, len(i) * dims)
    return i, np.frombuffer(matrix, {2: np.int16, 4: np.int32, 8: np.int64}.get(width, np.int16)).reshape(dims, len(i))


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `is_query` holds, the k rows of highest inner product of floor(scale * x)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), is_query.alias("is_query"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    n_slices, n_blocks = max(1, math.ceil(counts["n"] / CANDIDATES)), max(1, math.ceil(counts["q"] / QUERIES))
    slot = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    slices = _packed(rows.withColumn("b", slot(n_slices)), "b").withColumnRenamed("block", "slice")
    blocks = _packed(rows.where("is_query").dropDuplicates(["id", "v"]).withColumn("b", slot(n_blocks)), "b")
    # The stated query set meets all rows block by block: each query block is sent to each slice.
    sent = blocks.select("ids", "matrix", "dims", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice")).select("slice", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("dims").alias("q_dims"))
    pairs = sent.join(slices, "slice").repartition(n_slices * n_blocks, "slice", F.xxhash64("q_ids")).select("q_ids", "q_matrix", "q_dims", "ids", "matrix", "dims")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for many in batches:
            for one in range(many.num_rows):
                r = [c[one].as_py() for c in many.columns]
                qi, q = _unpack(*r[:3])
                ci, c = _unpack(*r[3:])
                d = max(len(q), len(c))
                q, c = (np.pad(m, ((0, d - len(m)), (0, 0))) for m in (q, c))
                row, found, s = best(q.T.astype(np.int64), qi, c, ci, k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(found), pa.array(s)], schema=schema)

    small_batches(vectors.sparkSession)
    part = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
