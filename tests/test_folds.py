"""Greedy acceptance and least-loaded assignment against plain folds."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ragloom.operators.greedy import greedy_accept, least_loaded


def fold(ids, links, base=()):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    accepted, out = [], {}
    for i in ids:
        by = sorted(set(base) & near[i]) or sorted(set(accepted) & near[i])
        out[i] = by[0] if by else None
        if not by:
            accepted.append(i)
    return out


@pytest.mark.parametrize("seed, n, m", [(1, 60, 40), (2, 60, 300), (3, 5, 0), (4, 200, 150)])
def test_greedy_accept_equals_the_fold(spark, seed, n, m):
    rng = random.Random(seed)
    ids = rng.sample(range(1000), n)
    base = sorted(rng.sample(sorted(ids), n // 8)) if seed % 2 else []
    links = [tuple(rng.choices(ids, k=2)) for _ in range(m)]
    links += links[:3]
    rows = spark.createDataFrame([(i, "x") for i in ids if i not in base], "id long, note string")
    known = spark.createDataFrame([(i,) for i in base], "id long") if base else None
    got, rounds = greedy_accept(rows, spark.createDataFrame(links, "a long, b long"), "id", known)
    want = fold(sorted(set(ids) - set(base)), [x for x in links if x[0] != x[1]], base)
    found = {r.id: r for r in got.collect()}
    assert {i: r.blocked_by for i, r in found.items()} == want
    assert all(r.accepted == (r.blocked_by is None) == (r.round is None) for r in found.values())
    assert rounds[-1] == 0 and rounds == sorted(rounds, reverse=True)


def test_a_chain_takes_a_round_for_each_second_row(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    got, rounds = greedy_accept(spark.range(10), links, "id")
    assert {r.id for r in got.collect() if r.accepted} == {0, 2, 4, 6, 8} and len(rounds) == 6


def test_a_star_of_a_third_of_the_rows_takes_one_round(spark):
    links = spark.range(1, 2000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got, rounds = greedy_accept(spark.range(6000), links, "id")
    assert got.where("accepted").count() == 4001 and len(rounds) == 2


def assign(requests, sources):
    out, loads = {}, defaultdict(dict)
    for key, s, load, tie in sources:
        if key is not None and load is not None:
            loads[key][s] = [load, tie, s]
    for key, order in sorted((r for r in requests if r[0] is not None), key=lambda r: r[1]):
        best = min(loads[key].values(), default=None)
        out[key, order] = best and (best[2], best[0])
        if best:
            best[0] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_least_loaded_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    keys = ["hot", "hot", "hot", "b", "c", "none"]
    requests = [(rng.choice(keys), i) for i in rng.sample(range(10_000), 300)] + [(None, -1)]
    sources = [(k, s, rng.choice([0, 1, 2, rng.randrange(60)]), rng.randrange(3)) for k in ("hot", "b", "c", "unused") for s in range(rng.randint(1, 12))]
    sources += [(None, 1, 1, 1), ("hot", 99, None, 0)]
    got = least_loaded(spark.createDataFrame(requests, "route string, at long"), spark.createDataFrame(sources, "route string, name long, load long, tie long"), key="route", order="at", source="name", load="load", tie="tie")
    assert {(r.route, r.at): r.source if r.source is None else (r.source, r.load_before) for r in got.collect()} == assign(requests, sources)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert greedy_accept(spark.range(0), none, "id")[0].count() == 0
    assert greedy_accept(spark.range(3), none, "id")[0].where("accepted").count() == 3
    requests, sources = spark.createDataFrame([], "k string, at long"), spark.createDataFrame([], "k string, s long, n long, t long")
    assert least_loaded(requests, sources, key="k", order="at", source="s", load="n", tie="t").count() == 0
