"""The stored lexical index against a plain BM25, its analyzer and the index text."""

import math
import random
import uuid
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ragloom.operators import lexical_index as L
from ragloom.plans.storage import shared_folder


def built(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string")
    return L.build_index(df, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")


def plain(rows, queries, k):
    docs = defaultdict(Counter)
    for i, text in rows:
        if i is not None:
            docs[i].update((text or "").lower().split())
    docs = {i: c for i, c in docs.items() if c}
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    out = set()
    for q, text in queries:
        scores = []
        for i, c in docs.items():
            terms = [t for t in set((text or "").lower().split()) if t in c]
            s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in terms)
            if terms:
                scores.append((-round(s, 6), i))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("shard_rows", [16, 32])
def test_equals_plain_bm25_with_fewer_postings(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(L, "SHARD_ROWS", shard_rows)
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    odds = [1 / (1 + i) for i in range(60)]
    rows = [(i, " ".join(r.choices(words, odds, k=r.randint(1, 60)))) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(5)] + [(None, "w1 w2"), (900, None), (901, ""), (3, "w59 w59"), (950, "w0 " * 20000)]
    queries = [(i, " ".join(r.choices(words, k=3))) for i in range(20)] + [(50, "w0 w59"), (51, ""), (52, None), (53, "unknown"), (54, "w0"), (55, "W3 w3 w3")]
    index, asked = built(spark, rows), spark.createDataFrame(queries, "query_id long, text string")
    got = {tuple(x) for x in L.search_index(index, asked, 4).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in plain(rows, queries, 4)}
    assert {(q, k): s for q, k, _, s in got} == pytest.approx({(q, k): s for q, k, _, s in plain(rows, queries, 4)}, abs=2e-6)
    read, of = L.needed_blocks(index, asked, 4).agg(F.sum(F.when(F.col("kept"), F.col("n"))), F.sum("n")).first()
    assert read < of


def test_empty_tables(spark):
    index = built(spark, [])
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert index.documents == 0 and L.search_index(index, asked, 3).count() == 0
    assert L.search_index(built(spark, [(1, "a")]), asked.limit(0), 3).count() == 0


def test_opened_index_is_the_stored_one(spark):
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    L.build_index(spark.createDataFrame([(1, "red pump"), (2, "red")], "id long, text string"), path)
    got = L.search_index(L.open_index(spark, path), spark.createDataFrame([(9, "pump")], "query_id long, text string"), 3).collect()
    assert [(x.query_id, x.rank, x.doc_id) for x in got] == [(9, 1, 1)]


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(L.analyze(F.col("t"))).first()[0]


def test_analyzer(spark):
    assert tokens(spark, "HAK-180, Öl E021!") == ["hak", "180", "öl", "e021"]
    assert tokens(spark, "温度传感器E9高") == ["温度", "度传", "传感", "感器", "e9", "高"]
    assert tokens(spark, "𠀀𠀁𠀂") == ["𠀀𠀁", "𠀁𠀂"]
    assert tokens(spark, None) == [] and tokens(spark, "") == [] and tokens(spark, "... \n") == []
    assert len(tokens(spark, "高" * 200_000)) == 199_999 and len(tokens(spark, "a" * 1_000_000)) == 1


def test_analyzer_check(spark):
    assert "e117" in L.check_analyzer(spark)
    with pytest.raises(ValueError, match="rx450, e117, Han text"):
        L.check_analyzer(spark, lambda t: F.regexp_extract_all(t, F.lit(r"[a-z]+"), F.lit(0)))


def test_index_text(spark):
    def text(*fields, cap=L.TEXT_CAP):
        return spark.range(1).select(L.lexical_text(*(F.lit(f).cast("string") for f in fields), cap=cap)).first()[0]

    assert text("  Pump  A ", None, "", "Pump A", "hot") == "Pump A\nhot"
    assert text(None, "") == ""
    assert text("see E-021") == "see E-021\nE021 E-021 E 021"
    assert text("see E-021 and more words", cap=24) == "see E-0\nE021 E-021 E 021"
    assert text("see E-021", cap=10) == "-021 E 021"
    assert len(text("x" * 300_000)) == L.TEXT_CAP


def test_search_makes_no_header_of_every_query_term_and_shard(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_ROWS", 1)
    monkeypatch.setattr(L, "_heads", None)
    index = built(spark, [(i, "pump " * (1 + i % 3)) for i in range(40)])
    asked = spark.createDataFrame([(i, "pump") for i in range(30)], "query_id long, text string")
    assert L.search_index(index, asked, 2).count() == 60
