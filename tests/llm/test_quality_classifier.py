import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F
from ragloom.llm.quality_classifier import GRAMS, PULL, ROWS, features, fit, labelled_rows, quality

GOOD = ["garden", "river", "bread", "window", "music", "ähre"]


def sentence(rng, bad):
    words = rng.choices(GOOD, k=rng.randint(5, 40))
    return " ".join(w + "###" for w in words) if bad else " ".join(words) + "."


def corpus(flip=False, seed=1, n=240):
    rng = random.Random(seed)
    docs = [(i, sentence(rng, i % 3 == 0), "en", "quality") for i in range(n)]
    return docs, [(i, int((i % 3 != 0) != flip)) for i in range(n)]


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, label string"), spark.createDataFrame(labels, "doc_id long, quality int")


def model_of(spark, docs, labels):
    d, x = frames(spark, docs, labels)
    return fit(d.select("doc_id", F.col("text").alias("t")), x.select("doc_id", F.col("quality").alias("label")))


def score(model, texts):
    return model.scores(*features(pa.array(texts, pa.string())))


def test_features_are_words_pairs_and_runs_of_characters():
    for text in ("", "ab", "one two two", "añb c\n\nd", "漢字仮名"):
        rows, borders = features(pa.array([text]))
        n = len(text.split())
        want = n + max(0, n - 1) + sum(max(0, len(text) - g + 1) for g in GRAMS)
        assert len(rows) == want == borders[-1] and (not want or 0 <= rows.min() <= rows.max() < ROWS)
    same, other = (set(features(pa.array([t]))[0]) for t in ("abc abc", "abd abd"))
    assert same & other  # a word twice in a row is a feature of its own
    assert not set(features(pa.array(["xyz"]))[0]) & set(features(pa.array(["xyZ "]))[0][1:])


def test_a_text_has_the_same_features_alone_and_in_any_batch():
    rng = random.Random(3)
    texts = [sentence(rng, i % 2 == 0) for i in range(30)] + ["", None, "a", "漢字 " * 300, "x" * 5000]
    rows, borders = features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert sorted(rows[borders[i] : borders[i + 1]]) == sorted(features(pa.array([t], pa.string()))[0])


def test_score_is_the_softmax_of_the_average(spark):
    """A plain forward pass: the mean of the rows' evidence, one text at a time."""
    docs, labels = corpus()
    model = model_of(spark, docs, labels)
    for text in ["", "garden river", "garden### river###", docs[0][1], docs[1][1]]:
        own = features(pa.array([text]))[0]
        z = sum(float(model.evidence[r]) for r in own) / (len(own) + PULL) + model.base
        assert abs(score(model, [text])[0] - 1 / (1 + np.exp(-(model.scale * z + model.shift)))) < 1e-5


def test_separates_held_out_texts_and_follows_the_labels(spark):
    for flip in (False, True):
        docs, labels = corpus(flip)
        got = {r.doc_id: r.score for r in quality(*frames(spark, docs, labels[:180])).collect()}
        assert sum((got[i] >= 0.5) != bool(label) for i, label in labels[180:]) <= 1


def test_other_columns_are_no_input(spark):
    docs, labels = corpus()
    first = {r.doc_id: r.score for r in quality(*frames(spark, docs, labels)).collect()}
    second = {r.doc_id: r.score for r in quality(*frames(spark, [(i, t, "de", str(i)) for i, t, _, _ in docs], labels)).collect()}
    assert first == second


def test_the_sample_is_bounded_weighted_and_the_same_each_time(spark):
    docs, labels = corpus()
    d, x = frames(spark, docs + [(0, "another text of the first id", "en", None)], labels)
    d, x = d.select("doc_id", F.col("text").alias("t")), x.select("doc_id", F.col("quality").alias("label"))
    a, b = (sorted(tuple(r) for r in labelled_rows(d.repartition(n), x.repartition(n), max_rows=50).collect()) for n in (1, 7))
    assert a == b and len(a) == 100 and len({r[0] for r in a}) == 100
    assert abs(sum(r[3] for r in a) - 240) < 1e-9


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    docs, labels = corpus()
    more = [(None, None, None, None), (None, "", "en", None), (5, docs[5][1], None, "x"), (900, "garden " * 40000, "en", "y")]
    rows = quality(*frames(spark, docs + more, [*labels, (None, 1), (7, None), (8, 5)])).collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1 and len({r.score for r in rows if r.doc_id is None}) == 1
    assert [r.score for r in quality(*frames(spark, docs[:3], [])).collect()] == [0.0] * 3
    assert quality(*frames(spark, [], labels)).collect() == []
