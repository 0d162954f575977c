"""Operator 13, quality classifier: supervised subword embeddings trained in numpy.

A text is the average of the learned vectors of its features: its words (A-Z lower-cased), its pairs of adjacent words and its runs of
3 to 5 characters as they stand, each hashed to a row of one table. A softmax over two outputs gives the probability. All is trained by
stochastic gradient descent on a bounded sample of labelled rows; the probabilities are calibrated on rows kept from training.

For scoring, each row's vector is multiplied by the output weights once: the average of the products is the product of the average, so
that a whole text costs one number for each feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.common import safe_text, table
from ragloom.llm.text_arrays import _BASE, _INVERSE, byte_view, mix, pieces, word_hashes
from ragloom.llm.toxicity import remainder

_U = np.uint64
ROWS, DIM, GRAMS = 1 << 18, 12, (3, 4, 5)
#: Bounds of the labelled sample that is fitted: rows of each label, and characters of a row.
MAX_ROWS, MAX_CHARS = 1200, 10_000
EPOCHS, RATE, SEED = 12, 1.0, 13
#: Features of no evidence that every text has besides its own: a text of a few characters leans to the base rate.
PULL = 10
#: Hash of a pair whose words are equal: what repetition looks like in any language.
_TWICE = _U(0x2545F4914F6CDD1D)
_BYTE = np.random.Generator(np.random.PCG64(13)).integers(1, 1 << 63, 256, dtype=np.uint64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(table rows of all features, borders of the texts). A text without any has none."""
    raw, borders = byte_view(texts)
    words, first, count = word_hashes(texts)
    of_word = np.repeat(np.arange(len(texts)), count)
    found, owner = [mix(words ^ _U(1))], [of_word]
    if len(words) > 1:
        same = of_word[1:] == of_word[:-1]
        pair = np.where(words[1:] == words[:-1], _TWICE, words[:-1] * _BASE + words[1:])
        found.append(mix(pair[same] ^ _U(2)))
        owner.append(of_word[1:][same])
    n = len(raw)
    if n:
        # characters begin at bytes other than 10xxxxxx; a run's hash is a difference of prefix sums, shifted to a common power
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        powers, back = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
        powers[0], powers[1:], back[0], back[1:] = 1, _INVERSE, 1, _BASE
        np.cumprod(powers, out=powers)
        np.cumprod(back, out=back)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers[:-1], out=sums[1:])
        edges = np.append(starts, n)
        of_char = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, borders)))
        for size in GRAMS:
            if len(starts) < size:
                continue
            begin, end = edges[: len(starts) - size + 1], edges[size:]
            inside = of_char[: len(begin)] == of_char[size - 1 :]
            begin, end = begin[inside], end[inside]
            found.append(mix((sums[end] - sums[begin]) * back[begin] + _U(size)))
            owner.append(of_char[: len(inside)][inside])
    rows, owner = (np.concatenate(found) & _U(ROWS - 1)).astype(np.int32), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


@dataclass
class Classifier:
    """What scoring needs: the evidence of every row, and probability = sigmoid(scale * (mean evidence + base) + shift)."""

    evidence: np.ndarray
    base: float
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def logits(self, rows: np.ndarray, borders: np.ndarray) -> np.ndarray:
        values = self.evidence[rows].astype(float)
        sums = np.append(0.0, np.cumsum(values))
        count = np.diff(borders)
        return (sums[borders[1:]] - sums[borders[:-1]]) / (count + PULL) + self.base

    def scores(self, rows: np.ndarray, borders: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(borders) - 1, self.constant)
        return _sigmoid(self.scale * self.logits(rows, borders) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bags_of(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its distinct rows and their shares of the average; little is held at once besides the bags themselves."""
    bags = []
    for _, part in pieces(texts, 1 << 17):
        rows, borders = features(part)
        for i in range(len(part)):
            own, times = np.unique(rows[borders[i] : borders[i + 1]], return_counts=True)
            bags.append((own, (times / (times.sum() + PULL)).astype(np.float32)))
    return bags


def train(bags: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, *, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Classifier:
    """Fit on all but a fifth of the texts, calibrate on that fifth (Platt scaling). Without texts of both labels: the labels' mean."""
    n = len(label)
    if n < 10 or label.min() == label.max():
        return Classifier(np.zeros(1, np.float32), 0.0, constant=float((weight * label).sum() / max(weight.sum(), 1e-9)) if n else 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    held, used = order[: n // 5], order[n // 5 :]
    if label[used].min() == label[used].max():
        held, used = order, order.copy()
    vectors = (rng.standard_normal((ROWS, DIM), np.float32) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    weight = weight / np.average(weight)
    step, steps = 0, epochs * len(used)
    for _ in range(epochs):
        rng.shuffle(used)
        for i in used:
            now = rate * (1 - step / steps)
            step += 1
            own, share = bags[i]
            mean = share @ vectors[own]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[label[i]] -= 1
            error *= min(weight[i], 4.0)
            back = out @ error
            out -= now * np.outer(mean, error)
            bias -= now * 0.1 * error
            if len(own):
                # dividing by the root of the shares' squares makes texts of any length move alike
                vectors[own] -= (now / np.sqrt((share * share).sum())) * share[:, None] * back
    evidence = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
    model = Classifier(evidence, float(bias[1] - bias[0]))
    z = np.array([bags[i][1] @ evidence[bags[i][0]] for i in held], float) + model.base
    most = max(1e-6, np.abs(z).max())
    a, b, y, w = 1.0, 0.0, label[held].astype(float), weight[held]
    z = z / most * 4
    for _ in range(2000):
        p = _sigmoid(a * z + b)
        a -= 0.3 * ((w * (p - y) * z).sum() / w.sum() + 0.005 * (a - 1))
        b -= 0.3 * ((w * (p - y)).sum() / w.sum() + 0.005 * b)
    model.scale, model.shift = max(a, 0.05) * 4 / most, b
    return model


def labelled_rows(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, t, label, weight of at most max_rows rows of each label by a hash of the id, of at most max_chars characters each.

    Each label's ids are picked by a limit that every partition applies first, so at most 2 * max_rows ids are sent to the texts. Of
    several texts of an id the one of least hash counts, so a repeated run fits the same rows. The weights restore the labels' shares.
    """
    shares = labels.groupBy("label").agg(F.count("*").alias("of"))
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    picked = [labels.where(F.col("label") == one).orderBy(*order).limit(max_rows) for one in (0, 1)]
    ids = picked[0].unionByName(picked[1]).join(F.broadcast(shares), "label")
    fit = docs.where(F.length("t") <= max_chars).join(F.broadcast(ids), "doc_id")
    one = fit.groupBy("doc_id", "label", "of").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("first"))
    return one.select("doc_id", F.col("first.t").alias("t"), "label", (F.col("of") / F.least(F.col("of"), F.lit(max_rows))).alias("weight"))


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Classifier:
    """docs: doc_id, t. labels: doc_id, label (0 or 1), one row per id."""
    sample = labelled_rows(docs, labels, **bounds).toArrow()
    ids = sample["doc_id"].to_numpy()
    sample = sample.take(pa.array(np.lexsort((ids, ids.astype(np.uint64) * _BASE)))).combine_chunks()
    texts = pa.concat_arrays([pa.array([], pa.large_string()), *sample["t"].cast(pa.large_string()).chunks])
    return train(bags_of(texts), sample["label"].to_numpy().astype(int), sample["weight"].to_numpy())


def score_texts(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score of every whole text of docs (doc_id, t)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(1), 1 << 19):
                scores = shared.value.scores(*features(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(np.round(scores, 6), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "t").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **bounds) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, of the whole text alone).

    Learns from the labels whose id is in docs (nulls and values other than 0 and 1 are left out, of several the greatest counts).
    Defined results: a null text is empty and scored like any, as the average of nothing; ids are passed through, null and repeated ones
    too; without labels of both kinds the score is the labels' mean (0 without labels); an empty table gives no rows; other columns are
    not read. Scores are rounded to 6 digits, below which the arithmetic of a batch shows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), safe_text(text_col).alias("t"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    return score_texts(src, fit(src, known, **bounds))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    out = quality(table(spark, sf_dir, "documents"), labels.where(remainder(F.col("doc_id"), 4) != 2))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
