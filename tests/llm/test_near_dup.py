import random

import pytest

from ragloom.llm.near_dup import near_dup
from tests.llm.brute import near_dup as brute

SCHEMA = "doc_id long, text string, node string, key string, n int"


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    docs = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(5, 120))
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 8))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += ["", None, "one", "One", "one two", "ONE\ttwo", "a b c", "a b c d", "a b c d e f", "a b c d e f g", "   "]
    rng.shuffle(docs)
    return [(i * 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("size", [1, 2, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, size, seed):
    docs = corpus(seed)
    got = near_dup(spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], SCHEMA), shingle_words=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_of_near_copies_stays_linear(spark, monkeypatch):
    """Copies that differ from one another more than from their base: the star of one turn is not enough."""
    from ragloom.llm import linking

    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for i in range(120):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(60)] = f"x{rng.random()}"
        docs.append((i, " ".join(copy)))
    met = []
    plain = linking._links
    monkeypatch.setattr(linking, "_links", lambda pairs, confirm, before, name: (met.append(pairs.count()), plain(pairs, confirm, before, name))[1])
    got = near_dup(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_on_both_sides_of_the_threshold(spark, monkeypatch, seed):
    """Copies with few and with many edits, drawn from few words: many pairs are just below the threshold."""
    from ragloom.llm import linking

    rng = random.Random(seed)
    base = [f"b{i}" for i in range(148)]
    docs = []
    for i in range(260):
        copy = list(base)
        for _ in range(rng.randint(1, 15)):
            copy[rng.randrange(148)] = f"x{rng.randrange(12)}"
        docs.append((i, " ".join(copy)))
    steps = []
    plain = linking._links
    monkeypatch.setattr(linking, "_links", lambda pairs, confirm, before, name: (steps.append(name), plain(pairs, confirm, before, name))[1])
    got = near_dup(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 2)
    assert "near-apart" in steps


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "alone here"), (9, None), (None, None)]
    got = near_dup(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == sorted([(0, 3, 4, False)] * 2 + [(4, 3, 4, True)] * 2 + [(0, 1, 0, True), (9, 0, 9, True), (0, 0, 0, True)])
    assert near_dup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
