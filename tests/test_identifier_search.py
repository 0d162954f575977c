"""Staged identifier search, same-record compatibility and verbatim spans against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from ragloom.operators import grounding
from ragloom.operators.identifier_search import compatible, covered, exact_hits, guaranteed, identifier_search, suggestions

MAP = "map<string,array<string>>"


def tokens(text):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z]+"), lambda w: w != "")


RECORDS = [
    (1, {"equipment_model": ["KX 40"], "alarm_code": ["E020"]}, {"equipment_model": ["KX 40"]}, "pump of the KX 40 stops"),
    (2, {"equipment_model": ["KX 40"]}, {"equipment_model": ["KX 40"]}, "see also code E-031 of this unit"),
    (3, {"alarm_code": ["E021"], "equipment_model": ["ZB 7"]}, {"alarm_code": ["E021"], "equipment_model": ["ZB 7"]}, "belt worn"),
    (4, {}, {}, "cleaning follows SOP 17-A every week"),
    (5, None, None, None),
]
REQUESTS = [
    ("both in one record", "why", {"equipment_model": ["KX 40"], "alarm_code": ["E020"]}),
    ("one only in the text", "why does code", {"equipment_model": ["KX 40"], "alarm_code": ["E031"]}),
    ("code of another device", "belt", {"equipment_model": ["KX 40"], "alarm_code": ["E021"]}),
    ("near code", "belt", {"alarm_code": ["E029"], "equipment_model": ["KX 40"]}),
    ("text only", "weekly cleaning", {"sop_code": ["SOP-17-A"]}),
    ("nothing like it", "belt", {"part_number": ["ZZZ-99999"]}),
    ("plain", "belt worn", {}),
    ("null", "belt worn", None),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, f"record_id int, metadata {MAP}, shown {MAP}, text string")


def test_a_query_ends_in_each_stage(spark, records):
    requests = spark.createDataFrame(REQUESTS, f"query_id string, query string, requested {MAP}")
    got = {r.query_id: r for r in identifier_search(requests, records, tokens, structured=["equipment_model", "alarm_code"]).collect()}
    assert {k: (r.status, r.stage) for k, r in got.items()} == {
        "both in one record": ("exact_match", 1),
        "one only in the text": ("fallback_exact_match", 2),
        "code of another device": ("suggestion_required", 3),
        "near code": ("suggestion_required", 3),
        "text only": ("exact_match", 2),
        "nothing like it": ("not_found", 3),
        "plain": ("not_applicable", 2),
        "null": ("not_applicable", 2),
    }
    assert got["both in one record"].record_ids == [1] and got["both in one record"].matched == {"equipment_model": ["KX 40"], "alarm_code": ["E020"]}
    assert got["one only in the text"].record_ids == [2] and got["text only"].record_ids == [4]
    assert got["near code"].suggested == {"alarm_code": ["E020"]}  # E021 is as near, but of another device
    assert got["code of another device"].suggested == {"alarm_code": ["E020", "E031"]}
    assert "E020" in got["near code"].question and got["plain"].question is None and got["plain"].record_ids == [3]
    assert got["near code"].matched is None and got["nothing like it"].suggested is None


def test_empty_tables(spark, records):
    requests = spark.createDataFrame(REQUESTS, f"query_id string, query string, requested {MAP}")
    none = identifier_search(requests, records.limit(0), tokens, structured=["alarm_code"]).collect()
    assert {r.status for r in none} == {"not_found", "not_applicable"} and all(r.record_ids == [] for r in none)
    assert identifier_search(requests.limit(0), records, tokens, structured=["alarm_code"]).count() == 0


def test_guarantee_fills_single_values_only(spark):
    rows = [({"a": ["x"]}, {"a": ["y"], "b": ["z"], "c": ["1", "2"], "d": ["w"]}), (None, {"b": ["z"]}), ({"b": []}, {"b": ["z"]})]
    got = spark.createDataFrame(rows, f"m {MAP}, r {MAP}").select(guaranteed(F.col("m"), F.col("r"), ["a", "b", "c"]).alias("g")).collect()
    assert [r.g for r in got] == [{"a": ["x"], "b": ["z"]}, {"b": ["z"]}, {"b": ["z"]}]


def test_compatibility_and_coverage_against_loops(spark):
    rng = random.Random(2)
    values = {"alarm_code": ["E100", "E200", "E300"], "part_number": ["AB-1", "CD-2"]}

    def some():
        return {k: rng.sample(v, rng.randint(1, len(v))) for k, v in values.items() if rng.random() < 0.7}

    requested = {q: some() for q in range(25)}
    metadata = {r: some() for r in range(40)}
    hits = [(q, requested[q], r, metadata[r], "") for q in requested for r in rng.sample(sorted(metadata), 6)]
    df = spark.createDataFrame(hits, f"query_id int, requested {MAP}, record_id int, metadata {MAP}, text string")
    matched = {(q, r): {k: [v for v in vs if v in m.get(k, [])] for k, vs in asked.items()} for q, asked, r, m, _ in hits}
    want = {k: m for k, m in matched.items() if all(m.values())}
    found = compatible(df)
    assert {(r.query_id, r.record_id): r.matched for r in found.collect()} == want
    asked = spark.createDataFrame([(q, v) for q, v in requested.items()], f"query_id int, requested {MAP}")
    full = {q for q, v in requested.items() if v and all(set(vs) <= {x for (p, _), m in want.items() if p == q for x in m[k]} for k, vs in v.items())}
    assert full and {r.query_id for r in covered(found, asked).collect()} == full


def test_suggestions_rank_by_distance_records_and_value(spark):
    codes = ["E100"] * 3 + ["E101"] * 2 + ["E102"] * 2 + ["E110", "E999"]
    records = spark.createDataFrame([(i, {"alarm_code": [c]}, "") for i, c in enumerate(codes)], f"record_id int, metadata {MAP}, text string")
    asked = spark.createDataFrame([(1, {"alarm_code": ["E10"]}), (2, {"alarm_code": ["E100", "E112"]}), (3, {"alarm_code": ["E555"]})], f"query_id int, requested {MAP}")
    got = {r.query_id: r.suggested for r in suggestions(asked, records).collect()}
    assert got == {1: {"alarm_code": ["E100", "E101", "E102"]}, 2: {"alarm_code": ["E101", "E102", "E110"]}}


def test_spans_against_find(spark):
    rng = random.Random(4)
    vocabulary = ["the", "pump", "valve", "öl", "5.2", "bar", "must", "e-20", "runs", "Über"]
    evidence = [(i, rng.choice(["", "  "]) + " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) + ".\n") for i in range(40)] + [(98, None), (99, "")]
    spans = []
    for n in range(60):
        text = rng.choice(evidence)[1] or "the pump"
        at = rng.randrange(max(1, len(text)))
        spans.append((n, text[at : at + rng.randint(8, 60)] if n % 4 else "no such span of words here"))
    rows = grounding.locate_spans(spark.createDataFrame(spans, "span_id int, span string"), spark.createDataFrame(evidence, "id int, text string")).collect()

    def inner(span):  # a word between two other characters
        import re

        return bool(re.sub(r"^\w+|\w+$", "", span).strip(" .\n-"))

    want = {(n, i): t.find(s) for n, s in spans if inner(s) for i, t in evidence if t and s in t}
    assert want and {(r.span_id, r.id): r.at for r in rows} == want and len(rows) == len(want)


def test_claims_of_every_kind(spark):
    fact = "Model AB12 must run below 5.2 bar. The cover may be removed at 40 degrees."
    claims = [
        (1, 1, "AB12 must run below 5.2 bar", "AB12 must run below 5.2 bar", "entailed"),
        (2, 1, "AB12 must run below 5.3 bar", "AB12 must run below 5.2 bar", "entailed"),
        (3, 1, "cover must be removed", "The cover may be removed must", "entailed"),
        (4, 1, "The cover must be removed", " cover may be removed", "entailed"),
        (5, 1, "AB12", "AB12", "neutral"),
        (6, 1, "AB12", None, None),
        (7, 9, "AB12", "AB12", "entailed"),
        (8, 1, "必须", "may", "entailed"),
    ]
    rows = grounding.grounded(spark.createDataFrame(claims, "claim_id int, evidence_id int, claim string, span string, relation string"), spark.createDataFrame([(1, fact)], "id int, text string"))
    got = {r.claim_id: (r.bound, r.entailed, r.span_in_fact, r.entities_consistent, r.strength_consistent, r.passed) for r in rows.collect()}
    assert got == {
        1: (True, True, True, True, True, True),
        2: (True, True, True, False, True, False),
        3: (True, True, False, True, True, False),
        4: (True, True, True, False, False, False),
        5: (True, False, True, True, True, False),
        6: (False, False, False, False, True, False),
        7: (True, True, False, True, True, False),
        8: (True, True, True, True, True, True),
    }
    totals = {r.evidence_id: (r.claims, r.passing, r.covered) for r in grounding.coverage(rows).collect()}
    assert totals == {1: (7, 2, False), 9: (1, 0, False)}


def test_requests_for_the_same_values_meet_the_records_once(spark):
    kind = "map<string,array<string>>"
    asked = spark.createDataFrame([(1, {"part_number": ["B", "A"]}), (2, {"part_number": ["A", "B", "A"]}), (3, {"part_number": ["C"]})], f"query_id long, requested {kind}")
    records = spark.createDataFrame([(i, {"part_number": ["A", "B"] if i == 5 else ["A"]}) for i in range(7)], f"record_id long, metadata {kind}")
    got = exact_hits(asked, records, ["part_number"], 2)
    assert {tuple(x) for x in got.collect()} == {(q, i, r) for q in (1, 2) for r, i in ((1, 5), (2, 0))}
