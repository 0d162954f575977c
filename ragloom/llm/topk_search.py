"""Operator 1, exact top-k search by no-random-access aggregation.

The items are dealt into blocks, the queries too; every pair of blocks is one task. In a task each dimension is a sorted list that is read
from the end that its query weight prefers. After each stretch of sequential reads every item has a lower bound (unread entries count as
the list's worst) and an upper bound (unread entries count as the list's frontier); when no outsider's upper bound reaches the k-th lower
bound the reading stops, and the survivors' final scores are resolved. The tasks' winners are then ranked per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.common import table

#: Rows of a block of items and of a block of queries: they bound a task's memory, not its result.
ITEM_ROWS, QUERY_ROWS = 2048, 512
#: Shares of the lists after which the bounds are compared; the last is the whole.
DEPTHS = (0.5, 0.85, 0.95, 1.0)


def nra_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of each query's k best in this block, ties to the smaller id; integers in float64 are exact here.

    All entries of a list that equal its frontier count as read, so ties at a frontier need no order.
    """
    n = len(ids)
    lists = np.sort(x, axis=0)
    worst_top, worst_low = lists[0], lists[-1]
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    todo, found = np.arange(len(q_ids)), []
    enough = max(8 * k, n // 32)
    for share in DEPTHS:
        depth = max(1, math.ceil(share * n))
        top, low = lists[n - depth], lists[depth - 1]
        upper = plus[todo] @ np.maximum(x, top).T + minus[todo] @ np.minimum(x, low).T
        lower = plus[todo] @ np.where(x >= top, x, worst_top).T + minus[todo] @ np.where(x <= low, x, worst_low).T
        own = q_ids[todo, None] == ids[None, :]
        upper[own] = lower[own] = -np.inf
        line = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(todo), -np.inf)
        alive = (upper >= line[:, None]) & ~own
        stop = (alive.sum(axis=1) <= enough) | (depth >= n)
        rows, cols = np.nonzero(alive[stop])
        rows = todo[stop][rows]
        score = np.einsum("ij,ij->i", q[rows], x[cols])
        order = np.lexsort((ids[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0)) if len(rows) else np.zeros(0, int)
        best = np.arange(len(rows)) - start < k
        found.append((rows[best], cols[best], score[best]))
        todo = todo[~stop]
        if not len(todo):
            break
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def topk_search(queries: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """Each query's k items of highest inner product: query_id, rank (from 1), vec_id, score.

    Both inputs have `vec_id` and `vec` (array<bigint>; sums below 2**53). Defined results: null ids and vectors that are null or hold a
    null take no part; vectors are compared only with those of their own length; an item with the query's id is the query's own and left
    out; repeated items are all ranked, repeated queries count once (one id with two vectors: two queries); ties go to the smaller id;
    an empty table gives no rows; other columns are not read.
    """
    spark = items.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        return df.select("vec_id", "vec", F.size("vec").alias("dim")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull()))

    queries, items = usable(queries).dropDuplicates(["vec_id", "vec"]), usable(items)
    n_items, n_queries = items.count(), queries.count()
    item_blocks, query_blocks = math.ceil(max(1, n_items) / ITEM_ROWS), math.ceil(max(1, n_queries) / QUERY_ROWS)

    def block(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "vec", F.lit(salt)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select("vec_id", "vec", F.xxhash64("vec").alias("same"), "dim", block(query_blocks, 1).alias("qb"), every(item_blocks).alias("ib"))
    right = items.select("vec_id", "vec", "dim", every(query_blocks).alias("qb"), block(item_blocks, 2).alias("ib"))

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x) or not q["dim"].iloc[0]:
            return pd.DataFrame({"query_id": [], "same": [], "vec_id": [], "score": []}).astype("int64")
        ids, q_ids = x["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        rows, cols, score = nra_block(q_ids, np.stack(q["vec"]).astype(float), ids, np.stack(x["vec"]).astype(float), k)
        return pd.DataFrame({"query_id": q_ids[rows], "same": q["same"].to_numpy()[rows], "vec_id": ids[cols], "score": score.astype("int64")})

    keys = ["dim", "qb", "ib"]
    won = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, same long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "same").orderBy(F.desc("score"), "vec_id"))
    return won.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """floor(scale * x) of every component, x as double; vectors with a null or non-finite component become null."""
    finite = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ints = F.transform(F.col(vector_col), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.when(finite, ints).alias("vec"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search(vectors.where(F.col("vec_id") % 100 == 0), vectors, k=10)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
