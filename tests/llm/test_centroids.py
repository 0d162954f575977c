import hashlib
import math
import random

import numpy as np

from pyspark.sql import functions as F
from ragloom.llm.centroids import BOUND, cluster_vectors, nearest, quantised


def plain(rows, k, rounds, seed=3):
    """[(vec_id, vector)] -> sorted [(vec_id, cluster, distance, inertia of the cluster, inertia, centroid)]."""
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    centroids = [list(v) for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in rows]
        for n in range(len(centroids)):
            own = [v for (_, v), c in zip(rows, of) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, near(v)) for i, v in rows]
    total = {n: sum(d for _, (d, c) in found if c == n) for n in range(len(centroids))}
    return sorted(((i, c, d, total[c], sum(total.values()), centroids[c]) for i, (d, c) in found), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, vec array<int>").withColumn("centroid", F.lit("other")).withColumn("n", F.lit(1))
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in cluster_vectors(df, **options).collect()), key=repr)


def test_equals_the_plain_rounds_over_all_rows(spark):
    rng = random.Random(4)
    base = [tuple(rng.randrange(-50, 50) for _ in range(4)) for _ in range(60)]
    rows = [(i, rng.choice(base)) for i in range(200)]
    rows += [(1000 + i, base[0]) for i in range(150)] + [(1, base[1]), (1, base[2]), (None, base[3]), (None, base[3])]
    for k, rounds in ((8, 10), (3, 1), (5, 0)):
        assert run(spark, rows, dim=4, k=k, rounds=rounds) == plain(rows, k, rounds)


def test_fewer_rows_than_centroids_ties_and_copies(spark):
    rows = [(5, (0, 0)), (6, (0, 0)), (7, (2, 2))]
    assert run(spark, rows, dim=2) == plain(rows, 8, 10)
    assert {r[1] for r in run(spark, [(i, (1, 1)) for i in range(9)], dim=2)} == {0}


def test_floors_of_negative_means(spark):
    rows = [(1, (-1,)), (2, (-2,)), (3, (-2,)), (4, (7,))]
    assert run(spark, rows, dim=1, k=1, rounds=1)[0][5] == [0] and run(spark, rows[:2], dim=1, k=1, rounds=1)[0][5] == [-2]


def test_large_components_stay_exact():
    x = np.array([[BOUND, -BOUND], [BOUND - 1, 3]], np.int64)
    best, distance = nearest(x, np.array([[-BOUND, BOUND], [BOUND, 0]], np.int64))
    assert list(best) == [1, 1] and list(distance) == [BOUND * BOUND, 10]


def test_what_takes_no_part(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [0.5, 0.0]), (2, [nan, 0.0]), (3, [inf, 0.0]), (4, None), (5, [0.5]), (6, [0.5, None]), (7, []), (8, [-0.0001, 1e30]), (9, [0.1, 0.2, 0.3])]
    got = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), dim=2)
    assert sorted((r.vec_id, list(r.vec)) for r in got.collect()) == [(1, [512, 0]), (8, [-1, BOUND])]


def test_empty_tables(spark):
    assert run(spark, [], dim=2) == []
    assert run(spark, [(None, (1, 2))], dim=2) == []
