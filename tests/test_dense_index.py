"""The clustered dense index against a plain cosine search."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import dense_index as D
from ragloom.operators import retrieval
from ragloom.plans.storage import shared_folder

SCHEMA = "id long, v array<double>"


def built(spark, rows, lists=None):
    return D.build_index(spark.createDataFrame(rows, SCHEMA), f"{shared_folder(spark)}/dense-{uuid.uuid4().hex}", lists)


def plain(rows, queries, k):
    out = {}
    for q, a in queries:
        found = []
        for i, b in rows:
            if i != q:
                size = np.linalg.norm(a) * np.linalg.norm(b)
                found.append((-(round(float(np.dot(a, b) / size), 6) + 0.0 if size else 0.0), i))
        out.update({(q, r): (i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)})
    return out


def check(got, want):
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in got}
    assert got.keys() == want.keys()
    for key, (i, s) in want.items():
        assert got[key][1] == pytest.approx(s, abs=2e-6)
        if got[key][0] != i:  # a score on the edge of a rounding may fall either way
            assert abs(got[key][1] - s) > 0 or abs(s - want.get((key[0], key[1] + 1), (0, s))[1]) <= 2e-6 or abs(s - want.get((key[0], key[1] - 1), (0, s))[1]) <= 2e-6


def around(r, centres, n):
    return [(i, (centres[i % len(centres)] + 0.15 * r.normal(size=8)).tolist()) for i in range(n)]


def test_equals_plain_search_with_fewer_pairs(spark):
    r = np.random.default_rng(3)
    rows = around(r, r.normal(size=(12, 8)), 900)
    queries = [x for x in rows if x[0] % 20 == 0] + [(5000, r.normal(size=8).tolist())]
    index, asked = built(spark, rows), spark.createDataFrame(queries, SCHEMA)
    check(D.search_index(index, asked, 5).collect(), plain(rows, queries, 5))
    pairs = D.needed_rings(index, asked, 5).join(index.rings, ["list", "ring"]).agg(F.sum("n")).first()[0]
    assert pairs < 0.5 * len(rows) * len(queries)


def test_random_vectors_copies_and_zeros(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 32)
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).tolist()) for i in range(200)]
    rows += [(300 + i, rows[4][1]) for i in range(150)] + [(600, [0.0] * 8), (601, [0.0] * 8)]
    queries = rows[:30] + rows[300:310] + [(600, [0.0] * 8), (9000, (-np.array(rows[4][1])).tolist())]
    check(D.search_index(built(spark, rows, 6), spark.createDataFrame(queries, SCHEMA), 7).collect(), plain(rows, queries, 7))


def test_bad_vectors_few_rows_and_empty_tables(spark):
    good = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    bad = [(4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0])]
    index = built(spark, good + bad)
    asked = spark.createDataFrame(good[:1] + bad, SCHEMA)
    assert [tuple(x) for x in D.search_index(index, asked, 5).orderBy("rank").collect()] == [(1, 1, 3, 0.707107), (1, 2, 2, 0.0)]
    assert D.search_index(index, asked.limit(0), 5).count() == 0
    assert D.search_index(built(spark, []), asked, 5).count() == 0


def test_opened_index_is_the_stored_one(spark):
    path = f"{shared_folder(spark)}/dense-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], SCHEMA)
    D.build_index(rows, path)
    assert [(x.query_id, x.vec_id) for x in D.search_index(D.open_index(spark, path), rows.where("id = 1"), 3).collect()] == [(1, 2)]


def test_choices_and_scores_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "CHOICES", 1)
    monkeypatch.setattr(D, "SLICE", 3)
    monkeypatch.setattr(retrieval, "SLICE", 3)
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    queries = rows[:10]
    want = plain(rows, queries, 5)
    asked, df = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(rows, SCHEMA)
    check(D.search_index(built(spark, rows, 6), asked, 5).collect(), want)
    check(retrieval.dense_top_k(asked, df, 5).collect(), want)
