import math
from collections import Counter

import pytest

from ragloom.llm.source_mixing import mix_sources

SCHEMA = "doc_id long, text string, source string, h string, block long"


def docs(spark, sizes, words=10):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * (1 + i % words)), source, "x", 1))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def tokens(rows):
    out = Counter()
    for r in rows:
        out[r.source] += len(r.text.split())
    return out


@pytest.mark.parametrize("block_rows", [4, 512])
def test_repetition_limit_and_budget(spark, block_rows):
    frame = docs(spark, {"a": 300, "b": 60, "c": 40})
    before = tokens(frame.collect())
    total = sum(before.values())
    got = mix_sources(frame, max_repetition=1.5, block_rows=block_rows, mix_tokens=200).collect()
    after = tokens(got)
    assert sum(after.values()) <= total and sum(after.values()) > total - 40
    assert max(after[s] / before[s] for s in before) == pytest.approx(1.5, abs=0.05)
    # every epoch but the last is whole, and no row comes twice in an epoch
    assert max(Counter((r.doc_id, r.mix_epoch) for r in got).values()) == 1
    assert Counter(r.doc_id for r in got if r.source == "c" and r.mix_epoch == 0) == Counter(range(360, 400))


def test_target_entropy(spark):
    frame = docs(spark, {"a": 400, "b": 50, "c": 50}, words=1)
    got = tokens(mix_sources(frame, max_repetition=None, target_entropy=0.9, block_rows=16).collect())
    p = [x / sum(got.values()) for x in got.values()]
    assert -sum(x * math.log(x) for x in p) == pytest.approx(0.9, abs=0.03)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "c d", "s"), (3, None, "s"), (4, None, "only"), (5, "", "only")]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repetition=1.0).collect()
    assert sorted((r.doc_id or 0, r.source or "") for r in got) == [(0, "s"), (1, ""), (1, ""), (3, "s")]
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    with pytest.raises(ValueError):
        mix_sources(docs(spark, {"a": 3}), max_repetition=1.0, target_entropy=1.0)
