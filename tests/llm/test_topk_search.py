import random

import numpy as np
import pytest

from ragloom.llm import topk_search as m


def brute(queries, items, k):
    out = []
    for q, x in queries:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in items if i != q and len(x) == len(y))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2048, 512), (7, 3)])
def test_equals_brute_force_with_ties(spark, monkeypatch, blocks):
    monkeypatch.setattr(m, "ITEM_ROWS", blocks[0])
    monkeypatch.setattr(m, "QUERY_ROWS", blocks[1])
    rng = random.Random(1)
    rows = [(i, [rng.randint(-3, 3) for _ in range(4)]) for i in range(120)] + [(i, [1, 2, 0, -1]) for i in range(200, 260)] + [(500, [1, 2])]
    frame = spark.createDataFrame(rows, "vec_id long, vec array<bigint>")
    got = m.topk_search(frame.where("vec_id % 10 = 0"), frame, k=5).collect()
    assert sorted(map(tuple, got)) == brute([r for r in rows if r[0] % 10 == 0], rows, 5)


def test_block_stops_early_and_is_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(-200, 200, (3000, 32)).astype(float)
    x[:50] *= 4
    ids = np.arange(3000)
    rows, cols, score = m.nra_block(ids[:20], x[:20], ids, x, 10)
    for r in range(20):
        s = x @ x[r]
        s[r] = -np.inf
        want = np.lexsort((ids, -s))[:10]
        assert list(cols[rows == r]) == list(want) and list(score[rows == r]) == list(s[want])


def test_nulls_and_empty_tables(spark):
    rows = [(0, [1.0, None]), (None, [1.0, 1.0]), (100, [0.5, float("nan")]), (200, [0.25, -0.5]), (300, None), (201, [1.0, 1.0]), (202, [float("inf"), 0.0]), (201, [1.0, 1.0])]
    ints = m.integer_vectors(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string"))
    got = m.topk_search(ints.where("vec_id % 100 = 0"), ints, k=3).collect()
    assert sorted(map(tuple, got)) == [(200, 1, 201, 1024 * 256 - 1024 * 512), (200, 2, 201, 1024 * 256 - 1024 * 512)]
    assert m.topk_search(ints.limit(0), ints).collect() == [] == m.topk_search(ints, ints.limit(0)).collect()
