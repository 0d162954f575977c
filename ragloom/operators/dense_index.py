"""Exact cosine top k over a stored clustered index: lists around centroids, rings of distance within a list, blocks of a ring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators.retrieval import BLOCK, SLICE, top_k
from ragloom.plans.storage import stored

#: Rows that the centroids are fitted on: those of least hash of the id. Every row is indexed, and searches are exact for any sample.
SAMPLE = 4096
#: Most lists; the centroids (lists x dimensions) go to all tasks.
MOST_LISTS = 1024
#: Rings per unit of distance; unit vectors are at most 2 apart, so a list has up to 2 * RINGS + 1 rings.
RINGS = 16
#: Choices of (query, list, ring) that a task holds at once; each carries the query's vector.
CHOICES = 1 << 15
#: Scores are rounded to 6 digits: what may still round to the k-th score stays.
SLACK = 2e-6


@dataclass(frozen=True)
class DenseIndex:
    """`rows`: list, ring, piece, id, v (length 1). `rings`: list, ring, n, near, far, pieces, at most MOST_LISTS * (2 * RINGS + 1) rows."""

    rows: DataFrame
    rings: DataFrame
    centroids: np.ndarray


def _whole(df: DataFrame, dimensions: int | None = None) -> DataFrame:
    """Rows with an id and a finite vector, as doubles; of `dimensions` components if given."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(~bad)
    return df if dimensions is None else df.where(F.size("v") == dimensions)


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squared = (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None, :] - 2 * (x @ centroids.T)
    return np.sqrt(np.maximum(squared, 0.0))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds on the sample from evenly spaced rows; a list without a row keeps its centroid."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        nearest = _distances(sample, centroids).argmin(axis=1)
        for i in np.unique(nearest):
            centroids[i] = sample[nearest == i].mean(axis=0)
    return centroids


def build_index(vectors: DataFrame, path: str, lists: int | None = None) -> DenseIndex:
    """Write the index of vectors (id, v; unique ids) below `path` and open it; `lists` is the root of the row count if not given.

    The commonest number of components in the sample is the index's; null, empty, non-finite and other vectors take no part. A ring is
    cut into pieces of about BLOCK rows by its own count, so a third of all rows around one point is many pieces.
    """
    spark, whole = vectors.sparkSession, _whole(vectors)
    sample = whole.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["v"]
    sizes = sample.map(len)
    dimensions = int(sizes.mode().iloc[0]) if len(sizes) else 1
    whole = _whole(vectors, dimensions)
    lists = min(MOST_LISTS, lists or max(1, round(whole.count() ** 0.5)))
    centroids = fit_centroids(_unit(sample[sizes == dimensions].to_list()), lists) if len(sizes) else np.zeros((1, 1))

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.iloc[start : start + BLOCK]
                x = _unit(part["v"].to_list())
                d = _distances(x, centroids)
                nearest = d.argmin(axis=1)
                # the distance again without the cancellation of the squares
                r = np.linalg.norm(x - centroids[nearest], axis=1)
                yield pd.DataFrame({"list": nearest.astype("int32"), "ring": (r * RINGS).astype("int32"), "r": r, "id": part["id"].to_numpy(), "v": list(x)})

    rows = stored(whole.mapInPandas(assigned, "list int, ring int, r double, id long, v array<double>"), "dense-assigned")
    pieces = F.ceil(F.col("n") / BLOCK).cast("int")
    rings = rows.groupBy("list", "ring").agg(F.count("*").alias("n"), F.min("r").alias("near"), F.max("r").alias("far")).withColumn("pieces", pieces)
    rings.coalesce(1).write.parquet(f"{path}/rings")
    dealt = rows.join(F.broadcast(spark.read.schema(rings.schema).parquet(f"{path}/rings").select("list", "ring", "pieces")), ["list", "ring"])
    dealt = dealt.select("list", "ring", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "id", "v")
    dealt.repartition("list", "ring", "piece").sortWithinPartitions("list", "ring").write.parquet(f"{path}/rows")
    spark.createDataFrame(enumerate(centroids.tolist()), "list int, v array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> DenseIndex:
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("list").toPandas()["v"]
    rings = spark.read.schema("list int, ring int, n long, near double, far double, pieces int").parquet(f"{path}/rings")
    return DenseIndex(spark.read.schema("list int, ring int, piece int, id long, v array<double>").parquet(f"{path}/rows"), rings, np.stack(centroids.to_list()))


def _chosen(index: DenseIndex, queries: DataFrame, k: int | None) -> DataFrame:
    """(query_id, v, list, ring) that each query reads: its nearest lists with more than k rows, or, with k None, every ring that may hold
    a score of `bound`: of a row at distance r from a centroid, a query at distance d is at least |d - r| away."""
    rings = index.rings.orderBy("list", "ring").toPandas()  # bounded by the lists and rings
    centroids, at = index.centroids, rings["list"].to_numpy()
    in_list = np.bincount(at, rings["n"].to_numpy(), minlength=len(centroids)) if len(rings) else np.zeros(len(centroids))

    # a query may choose every ring, so the more rings there are, the fewer queries are taken at once
    step = max(1, CHOICES // max(1, len(rings)))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch) if len(rings) else 0, step):
                part = batch.iloc[start : start + step]
                d = _distances(np.stack(part["v"].to_list()), centroids)
                if k is None:
                    gap = np.maximum(np.maximum(d[:, at] - rings["far"].to_numpy(), rings["near"].to_numpy() - d[:, at]), 0.0)
                    wanted = 1 - gap * gap / 2 >= part["bound"].to_numpy()[:, None] - SLACK
                else:
                    order = d.argsort(axis=1, kind="stable")
                    before = np.cumsum(in_list[order], axis=1) - in_list[order]
                    near = np.zeros(d.shape, dtype=bool)
                    np.put_along_axis(near, order, before <= k, axis=1)
                    wanted = near[:, at]
                q, r = np.nonzero(wanted)
                yield pd.DataFrame({"query_id": part["id"].to_numpy()[q], "v": part["v"].to_numpy()[q], "list": at[r], "ring": rings["ring"].to_numpy()[r]})

    return queries.mapInPandas(choose, "query_id long, v array<double>, list int, ring int")


def _scores(index: DenseIndex, chosen: DataFrame, k: int) -> DataFrame:
    """Scores of the chosen pairs, k a query and block; both sides of a product are bounded by pieces of about BLOCK rows."""
    keys = ["list", "ring", "piece", "part"]
    parts = chosen.groupBy("list", "ring").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    sizes = F.broadcast(stored(parts.join(index.rings.select("list", "ring", "pieces"), ["list", "ring"]), "dense-parts"))  # no more rows than rings
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = chosen.join(sizes, ["list", "ring"]).select("query_id", "v", "list", "ring", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), each("pieces").alias("piece"))
    right = index.rows.join(sizes.drop("pieces"), ["list", "ring"]).select("id", "v", "list", "ring", "piece", each("parts").alias("part"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, own = b["id"].to_numpy(), a["query_id"].to_numpy()
        x, y, found = np.stack(a["v"].to_list()), np.stack(b["v"].to_list()).T, []
        for start in range(0, len(own), SLICE):
            mine = own[start : start + SLICE]
            scores = np.round(x[start : start + SLICE] @ y, 6) + 0.0
            scores[mine[:, None] == ids[None, :]] = -np.inf
            least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(mine), -2.0)
            # all that reach the k-th, so that ties are settled by id afterwards
            q, c = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            found.append(pd.DataFrame({"query_id": mine[q], "vec_id": ids[c], "score": scores[q, c]}))
        return pd.concat(found, ignore_index=True)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    return top_k(found, ["query_id"], "score", "vec_id", k).select("query_id", "rank", "vec_id", "score")


def needed_rings(index: DenseIndex, queries: DataFrame, k: int) -> DataFrame:
    """The rings that the top k of queries (id, v) has to read: query_id, v (length 1), list, ring.

    The k-th score among the rows of a query's nearest lists is a lower bound of its final k-th; a query with fewer reads all rings.
    """
    unit = stored(_whole(queries, index.centroids.shape[1]).mapInPandas(_units, "id long, v array<double>"), "dense-queries")
    first = _scores(index, stored(_chosen(index, unit, k), "dense-nearest"), k)
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    return stored(_chosen(index, unit.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0))), None), "dense-chosen")


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "v": list(_unit(batch["v"].to_list()))})


def search_index(index: DenseIndex, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosine top k of queries (id, v), a query's own id left out: query_id, rank, vec_id, score (6 digits; ties to the smaller id).

    Zero vectors score 0. Queries that are null, not finite or of another number of components have no rows.
    """
    return _scores(index, needed_rings(index, queries, k), k)
