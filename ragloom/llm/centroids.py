"""Operator 11, centroid clustering over distinct vectors.

Identical quantised vectors are grouped with their multiplicities. Lloyd's rounds run over the distinct ones with weighted integer sums, so
that every round is exact and reads one row for each text of a group of copies; at the end the assignments are joined back to the ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.common import scratch, table, written

#: Components are held within this bound, so that squared distances up to 64 components fit 64 bits.
BOUND = 1 << 27
#: A vector that holds over 1 of this many rows is hot: there are fewer of them than this, so their table has a proven bound.
HOT_SHARE = 512


def quantised(embeddings: DataFrame, *, dim: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, vec: floor(scale * x) of vectors with exactly `dim` components, none null or non-finite; beyond BOUND: BOUND."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.col(vector_col).isNotNull() & (F.size(vector_col) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ints = F.transform(x, lambda v: F.floor(F.greatest(F.lit(float(-BOUND)), F.least(F.lit(float(BOUND)), F.lit(float(scale)) * v))).cast("int"))
    return embeddings.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("vec"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose '<seed>:<vec_id>' has the least sha256, ties by the vector; those without an id are none of them."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").orderBy(key, "vec").limit(k).select("vec").collect()  # k rows
    return np.array([r[0] for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row; ties to the smaller number; exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, x.shape[1]) < 1 << 53 else np.int64  # below 2**53 floating sums are exact, and faster
    a, b = x.astype(kind), centroids.astype(kind)
    distance = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(x)), best].astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, component, rows, sum) of every non-empty cluster, summed up by tasks first."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, n = _matrix(batch.column(0), dim), batch.column(1).to_numpy(zero_copy_only=False)
            best = nearest(x, centroids)[0]
            for c in range(k):
                own = best == c
                rows[c] += n[own].sum()
                total[c] += (x[own] * n[own, None]).sum(axis=0)
        found = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(rows[found]), pa.array(list(total[found]), pa.list_(pa.int64()))], ["cluster", "rows", "total"])

    parts = distinct.select("vec", "n").mapInArrow(run, "cluster long, rows long, total array<long>").select("cluster", "rows", F.posexplode("total").alias("place", "part"))
    # at most k * dim rows, whatever the input
    return parts.groupBy("cluster", "place").agg(F.sum("rows").alias("rows"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after `rounds` rounds over weighted vectors (vec, n): exact floors of the means; empty clusters keep theirs."""
    for _ in range(rounds):
        moved = centroids.copy()
        for cluster, place, rows, total in _sums(distinct, centroids):
            moved[cluster, place] = int(total) // rows
        if (moved == centroids).all():
            break  # every further round would be this one again
        centroids = moved
    return centroids


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec, n, cluster, distance."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch.column(0), dim), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec", "n", "cluster", "distance"])

    return distinct.select("vec", "n").mapInArrow(run, "vec array<int>, n long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, *, dim: int, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (array) of every row of vectors (vec_id, vec of ints).

    Defined results: rows with a null id are clustered and start no centroid; repeated ids and vectors count as often as they occur; with
    fewer than k rows with ids there are as many centroids; ties go to the smaller number; a table without usable vectors, or without
    any id, gives no rows; other columns are not read. Texts play no part. A sum of distances beyond 64 bits is null.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "vec")
    with scratch(spark):
        distinct = written(vectors.groupBy("vec").agg(F.count("*").alias("n")), "distinct")
        centroids = first_centroids(vectors, k, seed)
        if not len(centroids):
            return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
        centroids = lloyd(distinct, centroids, rounds)
        done = written(assigned(distinct, centroids), "assigned", up=1)

    # sums of n * distance: k rows
    own = done.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(20,0)") * F.col("distance").cast("decimal(19,0)")).alias("of")).collect()
    total = sum(int(r["of"]) for r in own)
    fits = lambda v: int(v) if v < 1 << 63 else None
    of = spark.createDataFrame([(r["cluster"], fits(r["of"]), fits(total), [int(v) for v in centroids[r["cluster"]]]) for r in own], "cluster int, cluster_inertia long, inertia long, centroid array<long>")

    # back to the ids: hot vectors, fewer than HOT_SHARE by their share of the rows, meet their rows without a shuffle
    rows = done.agg(F.sum("n")).first()[0] or 0
    hot = done.where(F.col("n") * HOT_SHARE > rows)
    columns = ["vec_id", "cluster", "distance"]
    back = vectors.join(F.broadcast(hot), "vec").select(*columns).unionByName(vectors.join(F.broadcast(hot.select("vec")), "vec", "left_anti").join(done, "vec").select(*columns))
    return back.join(F.broadcast(of), "cluster").select(*columns, "cluster_inertia", "inertia", "centroid")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster_vectors(quantised(table(spark, sf_dir, "embeddings"), dim=64), dim=64, k=8, rounds=10, seed=3)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.transform("centroid", lambda v: v.cast("string")), ","), 256).alias("centroid_sha256"))


def _sql(dim: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    def assign(at: int) -> str:
        distance = "CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        return f"a{at} AS MATERIALIZED (SELECT r, vec_id, v, cluster, d FROM (SELECT r, vec_id, v, cluster, {distance} AS d FROM x, c{at}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)"

    steps = []
    for i in range(rounds):
        steps.append(assign(i))
        floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
  SELECT cluster, list({floor} ORDER BY i) AS c FROM (SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {dim + 1}) t(i) GROUP BY ALL) GROUP BY 1) m ON m.cluster = c{i}.cluster)""")
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM x WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT {k}),
{", ".join(steps)}, {assign(rounds)}
SELECT vec_id, a{rounds}.cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda e: CAST(e AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


OP11_SQL = _sql()
