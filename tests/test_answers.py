"""Subjects and candidates against plain loops."""

import hashlib
import json
import random

from ragloom.operators import candidates, subjects

HITS = "mention string, rank int, score double, subject_id string, standard_name string"
CANDIDATE = "query_id long, rank int, score double, source_type string, document_id string, chunk_id string, title string, content string, url string"


def plain_subjects(sessions, mentions, hits):
    out = set()
    for s in sessions:
        said = [(at, m.strip()) for t, at, m in sorted((m for m in mentions if m[0] == s), key=lambda m: m[1]) if m and (m or "").strip()]
        sure, maybe, spent = {}, {}, False
        for at, mention in said:
            own = sorted((h for h in hits if h[0] == mention), key=lambda h: h[1])
            high = [h for h in own if h[2] > 0.75]
            if high:
                if high[0][3] and high[0][4]:
                    sure.setdefault(high[0][3], (at, 0, high[0][3], high[0][4]))
                continue
            for slot, h in enumerate([h for h in own if 0.6 < h[2] <= 0.75][:2]):
                if h[4]:
                    maybe.setdefault(h[4], (at, slot, None, h[4]))
        kind, rows = ("confirmed", sure) if sure else ("ambiguous", maybe) if maybe else ("not_found" if said else "no_mention", {0: (None,) * 4})
        out |= {(s, kind, *r) for r in rows.values()}
    return out


def test_confirm_subjects_is_the_plain_loop(spark):
    rng = random.Random(5)
    names = [f"m{i}" for i in range(12)]
    hits = [(m, rank, score, rng.choice(["s1", "s2", "s3", "", None]), rng.choice(["one", "two", "three", "", None])) for m in names[:10] for rank, score in enumerate(sorted((rng.choice([0.9, 0.76, 0.75, 0.7, 0.61, 0.6, 0.3]) for _ in range(rng.randint(0, 5))), reverse=True), 1)]
    mentions = [(s, at, rng.choice([*names, " m3 ", "", " "])) for s in range(40) for at in range(rng.randint(0, 4))]
    mentions += [(41, 0, None), (None, 0, "m1")]
    sessions = [*range(43), 0]
    got = subjects.confirm_subjects(spark.createDataFrame([(s,) for s in [*sessions, None]], "session_id long"), spark.createDataFrame(mentions, "session_id long, at int, mention string"), spark.createDataFrame(hits, HITS)).collect()
    want = plain_subjects(set(sessions), [m for m in mentions if m[2] is not None], hits)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {r.status for r in got} == {"confirmed", "ambiguous", "not_found", "no_mention"}


def test_alias_hits_against_all_pairs(spark):
    rng = random.Random(6)
    words = ["pump", "pumps", "valve", "valves", "motor", "heater"]
    aliases = [(" ".join(rng.choices(words, k=rng.randint(1, 3))), rng.choice(["1", "2", None]), "n") for _ in range(60)] + [("one alias", str(i), "n") for i in range(20)] + [(None, "1", "n")]
    said = [a[0] for a in aliases[:30]] + ["Pump valve motors", "one  ALIAS", "", " ", None, "--"]

    def grams(t):
        t = "".join(c for c in t.lower() if c.isalnum())
        return {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()

    want = set()
    for m in {(m or "").strip() for m in said} - {""}:
        x, found = grams(m), []
        for alias, subject, name in {a for a in aliases if a[0]}:
            y = grams(alias)
            if x and y and len(x & y) / len(x | y) > 0.6:
                found.append((-len(x & y) / len(x | y), subject is not None, subject or "", name, alias))
        want |= {(m, i, -h[0], h[2] if h[1] else None, h[3]) for i, h in enumerate(sorted(found)[:5], 1)}
    got = {tuple(r) for r in subjects.alias_hits(spark.createDataFrame([(m,) for m in said], "mention string"), spark.createDataFrame(aliases, "alias string, subject_id string, standard_name string")).collect()}
    assert got == want and len(got) > 40 and any(r[1] == 5 and r[0].startswith("one") for r in got)


def test_web_results(spark):
    pages = [{"url": " http://a/x ", "title": "T", "snippet": "s", "score": 0.5}, {"url": "", "snippet": "s"}, {"url": "u", "snippet": " "}, {"url": "u", "content": "c", "score": "0.9"}, {"url": "u2", "snippet": "s2", "score": -3}, {"url": "u3", "snippet": "s3", "score": 2, "extra": [1]}, None]
    rows = [(1, json.dumps({"pages": pages})), (2, None), (3, "no json"), (4, json.dumps({"pages": []})), (5, "{}"), (6, '{"pages": 3}')]
    got = candidates.web_candidates(spark.createDataFrame(rows, "query_id long, payload string"), "payload").orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.url, r.title, r.content, r.score) for r in got] == [(1, 1, "http://a/x", "T", "s", 0.5), (1, 4, "u", "u", "c", 0.0), (1, 5, "u2", "u2", "s2", 0.0), (1, 6, "u3", "u3", "s3", 2.0)]


def lists(spark, seed):
    rng, rows = random.Random(seed), {}
    for name in ("original", "hyde", "web"):
        rows[name] = [(q, rank, rng.random(), *(("web", None, None, rng.choice(["t", None]), rng.choice(["c", "d"]), f"http://H/{rng.randrange(5)}" + rng.choice(["", "/", "#f"])) if name == "web" else ("local", rng.choice(["d", None]), str(rng.randrange(6)), rng.choice(["t", "u", "", None]), rng.choice(["c", "d"]), None))) for q in range(4) for rank in range(1, rng.randint(1, 9))]
    return rows, {name: spark.createDataFrame(r, CANDIDATE) for name, r in rows.items()}


def identity(r):
    return f"web:http://h{r[8].split('#')[0].rstrip('/')[8:]}" if r[3] == "web" else f"local:{r[5]}"


def test_fusion_carries_the_richest_candidate(spark):
    rows, frames = lists(spark, 7)
    want = set()
    for q in range(4):
        votes, best, channels = {}, {}, {}
        for name, own in rows.items():
            seen = set()
            for r in (r for r in own if r[0] == q):
                i, fields = identity(r), dict(zip(candidates.FIELDS, (r[3], r[4], r[5], r[6], r[7], r[8]), strict=True))
                order = (-sum(v not in (None, "") for v in fields.values()), json.dumps(fields, sort_keys=True, separators=(",", ":")))
                best[i] = min(best.get(i, (order, fields)), (order, fields), key=lambda x: x[0])
                channels.setdefault(i, []).append(name)
                if i not in seen:
                    votes[i] = votes.get(i, 0) + 1 / (60 + r[1])
                seen.add(i)
        top = sorted(votes, key=lambda i: (-round(votes[i], 9), i))[:5]
        want |= {(q, n, i, round(votes[i], 9), ",".join(dict.fromkeys(channels[i])), *best[i][1].values()) for n, i in enumerate(top, 1)}
    got = candidates.fuse_candidates(frames, 5).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_channel_hits_flags(spark):
    rows, frames = lists(spark, 8)
    web, local = rows["web"][0], rows["original"][0]
    scored = [(web[0], 1, "web", None, web[8], 0.1), (web[0], 2, "web", None, web[8], None), (local[0], 1, "local", local[5], None, 0.9), (local[0], 2, "local", local[5], None, 0.4), (99, 1, "local", "0", None, 1.0)]
    cited = [(local[0], "local", local[5], None)] * 2
    got = candidates.channel_hits(frames, spark.createDataFrame(scored, "query_id long, at int, source_type string, chunk_id string, url string, rerank_score double"), spark.createDataFrame(cited, "query_id long, source_type string, chunk_id string, url string")).collect()
    assert len(got) == sum(map(len, rows.values()))
    for r in got:
        mine_web = r.query_id == web[0] and r.url == web[8]
        mine_local = r.query_id == local[0] and r.source_type == "local" and r.chunk_id == local[5]
        assert (r.entered_rerank, r.became_citation, r.rerank_score) == (mine_web or mine_local, mine_local, 0.4 if mine_local else None)
    assert {r.content_sha256 for r in got} <= {hashlib.sha256(c).hexdigest() for c in (b"c", b"d")}
    empty = spark.createDataFrame([], CANDIDATE)
    assert candidates.fuse_candidates({"a": empty}, 3).count() == 0
