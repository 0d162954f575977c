import random

import numpy as np
import pyarrow as pa
import pytest

from ragloom.llm.toxicity import fit, token_rows, toxicity
from pyspark.sql import functions as F

GOOD, BAD = ["garden", "river", "bread", "window", "music"], ["vile", "scum", "wretch", "filth"]


def sentence(rng, bad):
    return " ".join(rng.choices(GOOD, k=rng.randint(3, 30)) + ([rng.choice(BAD)] if bad else []))


def corpus(flip=False, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        docs.append((i, sentence(rng, bad), "en", "toxic"))
        labels.append((i, int(bad != flip)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, label string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = frames(spark, *corpus())
    src = docs.select("doc_id", F.col("text").alias("t"), "lang")
    return fit(src, labels.select("doc_id", F.col("toxic").alias("label")))[0]


def score(model, texts):
    return model.scores(*token_rows(pa.array(texts, pa.string())))


def test_a_text_scores_the_same_alone_and_in_any_batch(model):
    rng = random.Random(3)
    texts = [sentence(rng, i % 2 == 0) for i in range(40)] + ["", "vile", "a", None, "filth " * 5000, "汉字" * 300]
    alone = np.array([score(model, [t])[0] for t in texts])
    for _ in range(3):
        order = rng.sample(range(len(texts)), len(texts))
        together = score(model, [texts[i] for i in order])
        assert np.allclose(together, alone[order], atol=1e-6)


def test_words_of_any_length_are_read_to_their_end():
    base = "漢字仮名交じり文" * 12
    a, b = (token_rows(pa.array([base + end]))[0] for end in ("甲乙丙", "丁戊己"))
    assert a.shape == b.shape and not np.array_equal(a, b)
    a, b = (token_rows(pa.array(["x" * 300 + end]))[0] for end in ("a", "b"))
    assert not np.array_equal(a, b)
    rows, borders = token_rows(pa.array(["", None, "one Two"]))
    assert list(np.diff(borders)) == [2, 2, 4]


def test_separates_and_follows_the_labels(spark):
    for flip in (False, True):
        docs, labels = corpus(flip)
        got = {r.doc_id: r.score for r in toxicity(*frames(spark, docs, labels[:180])).collect()}
        wrong = sum((got[i] >= 0.5) != bool(label) for i, label in labels[180:])
        assert wrong <= 2


def test_one_long_labelled_text_shuts_out_no_other(spark):
    docs, labels = corpus()
    docs += [(1000 + i, "garden " * 6000, "en", None) for i in range(5)]
    labels += [(1000 + i, 0) for i in range(5)]
    got = {r.doc_id: r.score for r in toxicity(*frames(spark, docs, labels)).collect()}
    assert sum((got[i] >= 0.5) != bool(label) for i, label in labels[:240]) <= 2


def test_nulls_repeats_and_empty_tables(spark):
    docs, labels = corpus()
    more = [(None, None, None, None), (None, "", "en", None), (5, docs[5][1], None, "x"), (5, docs[5][1], "en", "y")]
    rows = toxicity(*frames(spark, docs + more, [*labels, (None, 1), (7, None)])).collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    none = toxicity(*frames(spark, docs[:3], [])).collect()
    assert [r.score for r in none] == [0.0] * 3
    assert toxicity(*frames(spark, [], labels)).collect() == []


def test_every_labelled_text_is_learnt_from(spark, monkeypatch):
    """A word that a single text of the most frequent label holds has its evidence, whatever the number and the lengths of the texts."""
    import ragloom.llm.toxicity as op

    docs, labels = [], []
    for i in range(1900):
        docs.append((i, f"garden only{i}" + " river" * (6000 if i % 600 == 0 else i % 5), "en"))
        labels.append((i, int(i % 10 == 0)))
    seen = {}
    monkeypatch.setattr(op, "started", lambda odds, begin=op.started: seen.setdefault("model", begin(odds)))
    src = spark.createDataFrame(docs, "doc_id long, t string, lang string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, label int")
    fit(src, known, rounds=1, shard_rows=300)
    rows = op.labelled(src, known)
    used = {r.doc_id for r in rows.where("NOT held").collect()}
    assert rows.count() == 1900 and 1400 < len(used) < 1620 and len([i for i in used if not labels[i][1]]) > 1200
    own = token_rows(pa.array([docs[i][1].split()[1] for i in sorted(used)]))
    odds = seen["model"].table[own[0][own[1][:-1], 0], 0]
    assert np.mean(odds != 0) > 0.99


def test_result_does_not_depend_on_partitions(spark):
    docs, labels = frames(spark, *corpus())
    one, two = ({r.doc_id: r.score for r in toxicity(docs.repartition(n), labels.repartition(n), shard_rows=60).collect()} for n in (1, 7))
    assert max(abs(one[i] - two[i]) for i in one) < 1e-4
