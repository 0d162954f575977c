
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import access, metrics, retrieval, sequences
from ragloom.sources import files, jsonl
from ragloom.streaming import rates

SF = "/root/testdata/sf0.001"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, want",
    [("HAK-180 machine", {"equipment_model": ["HAK 180"]}), ("E-020, HAK180", {"alarm_code": ["E020"], "equipment_model": ["HAK 180"]}), ("E020 vs E021", {"alarm_code": ["E020", "E021"]}), (None, {}), ("", {}), ("P/N: ab_12", {"part_number": ["AB-12"]})],
)
def test_identifiers(spark, text, want):
    assert one(spark, text, T.extract_identifiers("x")) == want


def test_subject_id_of_known_name(spark):
    assert one(spark, "HAK 180 烫金机", T.subject_id("x")) == "subject_02cd03d5e0dc8d2b"


@pytest.mark.parametrize("url, want", [("HTTP://A.com/x/?Q=1#f", "http://a.com/x?Q=1"), ("http://a.com", "http://a.com/"), ("plain//", "plain"), (" ", None), (None, None)])
def test_canonical_url(spark, url, want):
    assert one(spark, url, T.canonical_url("x")) == want


def test_cliff(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.88), (1, 3, 0.2), (1, 4, 0.1), (2, 1, 0.5), (3, 1, None), (3, 2, None)]
    got = retrieval.cliff_cut(spark.createDataFrame(rows, "query_id long, rank long, score double"))
    assert sorted((r["query_id"], r["rank"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]


def test_dense_top_k_skips_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = retrieval.dense_top_k(df.where("id = 0"), df, 2).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, 1.0)]
    assert retrieval.dense_top_k(df.limit(0), df, 2).count() == 0


def test_dense_top_k_over_several_blocks(spark, monkeypatch):
    """Ties, repeats and queries of several blocks and slices against a plain sort."""
    rng, found = random.Random(4), {}
    for name, rows in (("BLOCK", 16), ("WIDE", 24), ("SLICE", 5)):
        monkeypatch.setattr(retrieval, name, rows, raising=False)
    vectors = {i: [float(rng.randint(-2, 2)) for _ in range(3)] for i in range(150)}
    df = spark.createDataFrame([*vectors.items(), (None, [1.0, 1.0, 1.0])], "id long, v array<float>")
    for r in retrieval.dense_top_k(df, df, 4, cosine=False).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    dot = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b]))
    want = {a: [(n + 1, b, dot(a, b)) for n, b in enumerate(sorted((b for b in vectors if b != a), key=lambda b: (-dot(a, b), b))[:4])] for a in vectors}
    assert {a: sorted(rows) for a, rows in found.items()} == want


def test_every_vector_asks_for_its_cliff(spark):
    """Not the vectors of every twentieth id alone."""
    from ragloom.plans.catalogue import QUERIES

    ids = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    assert {r.query_id for r in QUERIES["dynamic_topk_cliff"](spark, SF).select("query_id").distinct().collect()} == ids


def test_visibility(spark):
    rows = [(1, "public", 9, 9), (2, "shared", 3, 9), (3, "shared", 4, 9), (4, "private", 3, 7), (5, "private", 3, 8), (6, None, 3, None)]
    df = spark.createDataFrame(rows, "i long, visibility string, tenant_id long, owner_user_id long").withColumn("dataset_id", F.lit(1)).withColumn("enabled", F.lit(True))
    assert sorted(r["i"] for r in access.accessible(df, [1], tenant_id=3, user_id=7).collect()) == [1, 2, 4]
    with pytest.raises(ValueError):
        access.accessible(df, [], tenant_id=3, user_id=7)


def test_upsert_and_replace(spark):
    old, new = (spark.createDataFrame(r, "k long, made string, v string") for r in ([(1, "a", "x"), (2, "a", "y")], [(2, "b", "z"), (3, "b", "w")]))
    assert sorted(map(tuple, files.upserted(old, new, ["k"], ["made"]).collect())) == [(1, "a", "x"), (2, "a", "z"), (3, "b", "w")]
    assert sorted(map(tuple, files.replaced(old, new, ["k"]).collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "b", "w")]


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "i long, t string")
    files.write_jsonl(df, str(tmp_path / "x"))
    (tmp_path / "x" / "more.json").write_text("# note\n\n")
    assert sorted(map(tuple, jsonl.read_jsonl(spark, str(tmp_path / "x"), df.schema).collect())) == [(1, "a\nb"), (2, None)]


def test_renumbered(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a")]
    got = sequences.renumbered(spark.createDataFrame(rows, "d long, i long, p string"), "d", "i", "p")
    assert [r["part"] for r in got.orderBy("i").collect()] == [1, 2, 1, 1]


def test_rate_limit_stream(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"user_id": [1] * 5 + [2], "ts": [start + pd.Timedelta(seconds=s) for s in (0, 1, 2, 61, 62, 5)]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    query = rates.rate_limited(stream, "user_id", "ts", limit=2, seconds=60).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("admitted").where("key = 1").orderBy("ts").collect()
    assert [r["admitted"] for r in got] == [True, True, False, True, True]


def test_gates(spark):
    df = spark.createDataFrame([(1.0, 0, 0, 0.7, 0.6, 0)], "format_rate double, failures int, forbidden int, macro_accuracy double, min_bucket_accuracy double, false_releases int")
    assert {r["gate"]: r["passed"] for r in metrics.gate_checks(df).collect()} == {"format_rate": True, "failures": True, "forbidden": True, "macro_accuracy": False, "min_bucket_accuracy": True, "false_releases": True}
