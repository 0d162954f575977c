import random

import pytest

from pyspark.sql import functions as F
from ragloom.llm.point_in_time import ActiveTree, op12_point_in_time, point_in_time, winners

VERSION = "k string, event long, arrival long, expiry long, version_id long, n long, s string"


def run(spark, asks, versions, **options):
    v = spark.createDataFrame(versions, VERSION).withColumn("payload", F.struct("n", "s"))
    return point_in_time(spark.createDataFrame(asks, "n int, k string, t long, payload string"), v, key="k", **options)


def plain(ask, versions):
    _, k, t, _ = ask
    if k is None or t is None:
        return None
    usable = [v for v in versions if None not in v[:5] and v[0] == k and v[1] <= t and v[2] <= t < v[3]]
    best = max(usable, key=lambda v: (v[1], -v[2], v[4], v[5], v[6]), default=None)
    return best and (best[1], best[2], best[4], (best[5], best[6]))


def test_every_older_root_stays_as_it_was():
    rng = random.Random(1)
    tree, root, active, seen = ActiveTree(37), 0, set(), []
    for _ in range(400):
        r = rng.randrange(37)
        root = tree.edit(root, r, r not in active)
        active ^= {r}
        seen.append((root, max(active, default=-1)))
    assert all(tree.most[root] == most for root, most in seen)


def test_edits_copy_one_path():
    tree, root = ActiveTree(1 << 12), 0
    for r in range(1 << 12):
        before = len(tree.most)
        root = tree.edit(root, r, True)
        assert len(tree.most) - before <= 12


def test_winners_against_a_scan():
    rng = random.Random(2)
    for n in (0, 1, 2, 60):
        spans = [(a := rng.randrange(100), a + rng.randrange(-2, 40)) for _ in range(n)]
        asked = list(range(-3, 150))
        assert winners(spans, asked) == [max((i for i, (a, b) in enumerate(spans) if a <= t < b), default=-1) for t in asked]


@pytest.mark.parametrize("slab", [1, 7, 32, 5000])
def test_equals_a_scan_of_all_versions_at_any_slab(spark, slab):
    rng = random.Random(slab)
    versions, asks = [], []
    for i in range(300):
        event = rng.randrange(-200, 400)
        versions.append((rng.choice("aaab"), event, event + rng.randrange(-20, 60), event + rng.choice([0, 5, 60, 900, 3000]), rng.randrange(200), rng.randrange(3), rng.choice(["x", "y"])))
    versions += versions[:20] + [(None, 1, 1, 9, 1, 1, "x"), ("a", None, 1, 9, 1, 1, "x"), ("a", 1, None, 9, 1, 1, "x"), ("a", 1, 1, None, 1, 1, "x"), ("a", 1, 1, 900, None, 1, "x")]
    for i in range(200):
        asks.append((i, rng.choice("aabc"), rng.randrange(-300, 3000), "own"))
    asks += asks[:5] + [(900, None, 3, None), (901, "a", None, None)]
    rows = run(spark, asks, versions, slab_seconds=slab).collect()
    got = sorted(((r.n, r.k, r.t, r.payload, r.version and (r.version.event, r.version.arrival, r.version.version_id, tuple(r.version.payload))) for r in rows), key=repr)
    assert got == sorted(((*a, plain(a, versions)) for a in asks), key=repr)


def test_empty_tables(spark):
    assert run(spark, [], [("a", 1, 1, 9, 1, 1, "x")]).collect() == []
    assert run(spark, [(1, "a", 3, None)], []).first().version is None


def test_a_hot_key_takes_many_groups_and_copies_are_reduced_first(spark):
    versions = [("a", i % 600, i % 600, i % 600 + 30, i, 1, "x") for i in range(6000)]
    asks = [(i, "a", i % 640, None) for i in range(2000)]
    rows = run(spark, asks, versions).collect()
    assert len(rows) == 2000 and all((r.version is None) == (r.t >= 629) for r in rows)
    assert all(r.version.version_id % 600 == min(r.t, 599) for r in rows if r.version)


def test_query_takes_null_and_repeated_ids(spark, tmp_path):
    docs = [(1, "t", "en", "s", 1), (1, "u", "de", "r", 5), (None, "x", "en", "s", 2), (3, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, 1), (4, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = op12_point_in_time(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and [r.t for r in rows if r.doc_id is None] == [None]
    assert all(r.status == "none" and r.version_id is None for r in rows if r.doc_id != 1)


