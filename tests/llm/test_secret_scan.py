import random
import re
import time

from ragloom.llm.secret_scan import ACCESS, ASSIGN, DOMAIN, HEX, WEAK, secret_scan

ENDPOINT = r"(?<![A-Za-z0-9-])[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"


def spans(pattern, text, kind, rank, keep):
    return [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if keep(m)]


def brute(text, scope=300):
    text = text or ""
    base = spans(ASSIGN, text, "assign", 0, lambda m: len(m[2]) >= 6) + spans(ACCESS, text, "access", 1, lambda m: len(m[0]) >= 20) + spans(HEX, text, "hex", 2, lambda m: len(m[0]) >= 24)
    weak = spans(WEAK, text, "linked", 9, lambda m: all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]")))
    ends = spans(ENDPOINT, text, "endpoint", 8, lambda m: re.search(DOMAIN, m[0]))

    def near(w, kind):
        return any(p[3] == kind and (0 <= w[0] - p[2] <= scope or p[2] > w[0] >= p[0] or 0 <= p[0] - w[2] <= scope or w[0] <= p[0] < w[2]) for p in base + ends)

    linked = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base) and (near(w, "access") or (near(w, "endpoint") and near(w, "assign")))]
    return sorted(base), sorted(base + linked)


def check(spark, texts):
    got = secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        base, every = brute(texts[r.doc_id])
        assert [tuple(s) for s in r.base] == base, texts[r.doc_id][:300]
        assert [tuple(s) for s in r.spans] == every, texts[r.doc_id][:300]
    return [brute(t) for t in texts]


def test_parts_in_any_order_and_distance(spark):
    rng = random.Random(7)
    body = lambda: "".join(rng.choices("abcdefXYZ0189+/", k=34)) + "aB3"
    pieces = [body, lambda: "AKIA" + "".join(rng.choices("ABCXYZ019", k=16)), lambda: "https://db.example.com/x", lambda: "password = hunter2222", lambda: "api.host.internal.", lambda: "deadbeef" * 3, lambda: "é" * rng.randint(1, 40), lambda: " word" * rng.randint(1, 70), lambda: "token: " + body()]
    texts = [" ".join(rng.choice(pieces)() for _ in range(rng.randint(1, 12))) for _ in range(400)]
    found = check(spark, texts)
    assert sum(len(every) > len(base) for base, every in found) > 40
    assert any("AKIA" in t for t in texts)


def test_scope_border(spark):
    body, key = "abcdefghijklmnopqrstuvwxyzABCDEFGH12345", "AKIA" + "Q" * 16
    texts = [f"{key}{' ' * n}{body}" for n in (299, 300, 301)] + [f"{body}{' ' * n}{key}" for n in (299, 300, 301)]
    assert [len(every) - len(base) for base, every in check(spark, texts)] == [1, 1, 0, 1, 1, 0]


def test_hostile_and_long_texts(spark):
    body = "abcdefghijklmnopqrstuvwxyzABCDEFGH12345"
    texts = [f"{body} " + "a." * 3000, f"{body} " + "a" * 1_000_000, f"{body} " + "a." * 300_000 + "com", f"{body} " + "-" * 300_000, ("f" * 24 + " ") * 6000 + body, ("x.com " + body + " ") * 1500 + "password=aaaaaaa", "secret" * 100_000, "password: " * 50_000, None, ""]
    began = time.time()
    check(spark, texts)
    assert time.time() - began < 120


def test_repeats_nulls_and_empty_tables(spark):
    rows = [(None, "password=abcdef", "k"), (None, "password=abcdef", "k"), (3, None, None)]
    got = secret_scan(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()
    assert sorted((r.doc_id or 0, len(r.base)) for r in got) == [(0, 1), (0, 1), (3, 0)]
    assert secret_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
