"""Operator 7, toxicity: a convolutional text classifier trained in numpy on shards of all labelled texts, whose models are averaged.

A word's embedding is the sum of hashed rows: the word, and its beginnings of 3 to 6 bytes, so that unseen endings share what was learned.
Filters of several widths run over the words, each is max-pooled over the whole text, and a logistic layer gives the score, calibrated
on rows kept from training. Thresholds are calibrated by language; the language is never an input of the score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.common import free, safe_text, scratch, table, written
from ragloom.llm.text_arrays import _BASE, _INVERSE, byte_view, mix, pieces

_U = np.uint64
ROWS, DIM, FILTERS, WIDTHS = 1 << 18, 16, 8, (1, 2, 3)
BEGINNINGS = (3, 4, 5, 6)
PAD = max(WIDTHS) - 1
#: Slope below 0, so that no filter stops learning.
LEAK = 0.05
#: Labelled texts that learn in one shard, about, and in one step; rows of the table in a block of sums; place of the layers' sums behind them.
SHARD_ROWS, BATCH, BLOCK, LAYERS = 2048, 32, 1024, 1 << 19
#: Bits of the filter of labelled ids.
BITS = 1 << 24
_GRID = np.linspace(0.05, 0.95, 19)

#: Bytes of a run from which it counts as a script without spaces if it has non-ASCII bytes, and characters of its pieces.
LONG_WORD, PIECE = 48, 2

_WORD = np.ones(256, bool)
_WORD[[i for i in range(128) if not chr(i).isalnum()]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def whole_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of the bytes from each start to its end, whatever their number, from prefix sums."""
    powers, back = np.empty(len(raw) + 1, np.uint64), np.empty(len(raw) + 1, np.uint64)
    powers[0], powers[1:], back[0], back[1:] = 1, _INVERSE, 1, _BASE
    np.cumprod(powers, out=powers)
    np.cumprod(back, out=back)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * powers[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * back[starts]


def cut_words(inside: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs with non-ASCII bytes and over LONG_WORD bytes (scripts without spaces) as pieces of PIECE characters, the last shorter."""
    far = np.flatnonzero(ends - starts > LONG_WORD)
    if not len(far):
        return starts, ends
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # first bytes of characters
    more = []
    for i in far:
        own = lead[np.searchsorted(lead, starts[i]) : np.searchsorted(lead, ends[i])]
        if (raw[starts[i] : ends[i]] > 127).any():
            more.append(own[PIECE::PIECE])
    if not more:
        return starts, ends
    cuts = np.concatenate(more)
    return np.sort(np.r_[starts, cuts]), np.sort(np.r_[ends, cuts])


def token_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(embedding rows of every word, (n, 1 + len(BEGINNINGS)), borders of the texts), PAD empty words after each text (row ROWS).

    A word is a run of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased; of scripts without spaces, PIECE characters.
    """
    raw, borders = byte_view(texts)
    raw = _LOWER[raw]
    n = len(raw)
    inside = _WORD[raw]
    cut = np.zeros(n + 1, bool)
    cut[borders] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | cut[:-1])) if n else np.zeros(0, int)
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | cut[1:])) + 1 if n else np.zeros(0, int)
    starts, ends = cut_words(inside, raw, starts, ends)
    length = ends - starts
    state = np.zeros(len(starts), np.uint64)
    columns = np.zeros((len(starts), 1 + len(BEGINNINGS)), np.int32)
    alive = np.arange(len(starts))
    for i in range(max(BEGINNINGS)):
        alive = alive[length[alive] > i]
        state[alive] = (state[alive] ^ raw[starts[alive] + i]) * _U(0x100000001B3) + _U(0x9E3779B97F4A7C15)
        if i + 1 in BEGINNINGS:
            # a shorter word has no beginning of this length and gets the row of its own whole
            columns[alive, 1 + BEGINNINGS.index(i + 1)] = (mix(state[alive] + _U(i + 1)) & _U(ROWS - 1)).astype(np.int32)
    state = state if not n else whole_hashes(raw, starts, ends)
    columns[:, 0] = (mix(state + length.astype(np.uint64) * _U(0x632BE59BD9B4E019)) & _U(ROWS - 1)).astype(np.int32)
    for j, size in enumerate(BEGINNINGS):
        columns[:, 1 + j] = np.where(length >= size, columns[:, 1 + j], columns[:, 0])
    first = np.searchsorted(starts, borders)
    padded = np.full((len(starts) + PAD * len(texts), columns.shape[1]), ROWS, np.int32)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    padded[np.arange(len(starts)) + PAD * doc] = columns
    return padded, first + PAD * np.arange(len(texts) + 1)


@dataclass
class Model:
    """Weights of the network; probability = sigmoid(scale * logit + shift)."""

    table: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word vectors, filter values of every place)."""
        x = self.table[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            x = x + self.table[rows[:, j]]
        y = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        for w, kernel in enumerate(self.kernels):
            part = x @ kernel[0]
            for o in range(1, len(kernel)):
                part[:-o] += x[o:] @ kernel[o]
            y[:, w * FILTERS : (w + 1) * FILTERS] = part
        return x, y

    def logits(self, rows: np.ndarray, borders: np.ndarray) -> np.ndarray:
        # the last PAD places of a text are empty words, where a window would reach into the next text: only the first of them, all empty
        # for widths up to PAD, may start one, so that a text without words has a value
        values = self.windows(rows)[1]
        for back in range(1, PAD + 1):
            values[borders[1:] - back] = 0 if back == PAD else -np.inf
        pooled = np.maximum.reduceat(values, borders[:-1], axis=0)
        return _rectified(pooled + self.bias) @ self.out + self.base

    def scores(self, rows: np.ndarray, borders: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(borders) - 1, self.constant)
        return _sigmoid(self.scale * self.logits(rows, borders).astype(float) + self.shift)


def _rectified(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, LEAK * x)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def started(odds: np.ndarray, seed: int = 7) -> Model:
    """The network before its first step; the first dimension of every row holds its evidence."""
    rng = np.random.default_rng(seed)
    table = (0.05 * rng.standard_normal((ROWS + 1, DIM))).astype(np.float32)
    table[:, 0] = odds / 5
    table[ROWS] = 0
    kernels = [(rng.standard_normal((w, DIM, FILTERS)) / math.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
    for kernel in kernels:
        kernel[:, 0, : FILTERS // 2] = 1
        kernel[:, 0, FILTERS // 2 : 3 * FILTERS // 4] = -1  # evidence against
    return Model(table, kernels, np.full(FILTERS * len(WIDTHS), -1.0, np.float32), np.where(np.arange(FILTERS * len(WIDTHS)) % FILTERS // (FILTERS // 4) == 2, -0.3, 0.3).astype(np.float32), -2.0)


class Learner:
    """Steps of one shard from a model. The weights of the layers lie in one vector: kernels, bias, out, base, and Adam's two moments of all
    but the base; the table of embeddings takes plain steps and knows which of its rows have moved."""

    def __init__(self, model: Model, dense: np.ndarray, rate: float) -> None:
        self.begin, self.start, self.rate = model.table, dense, rate
        self.table = model.table.copy()
        self.reset()

    def reset(self) -> None:
        if hasattr(self, "touched"):
            self.table[self.touched] = self.begin[self.touched]
        self.dense, self.touched, self.step = self.start.copy(), np.zeros(ROWS + 1, bool), 0
        self.model = unpacked(self.table, self.dense)

    def learn(self, batch: list[np.ndarray], label: np.ndarray, before: int) -> None:
        """One step on whole texts (rows of their words, PAD empty ones at the end). before: steps of the rounds before this one."""
        self.step += 1
        columns, widest = FILTERS * len(WIDTHS), max(WIDTHS)
        width = np.repeat(WIDTHS, FILTERS)
        x_at, row_at, pooled = [], [], []
        for group in _groups(batch):
            x, y = self.model.windows(np.concatenate(group))
            at = 0
            for own in group:
                stop = at + len(own)
                y[stop - PAD], y[stop - PAD + 1 : stop] = 0, -np.inf
                best = at + y[at:stop].argmax(axis=0)
                place = best[:, None] + np.arange(widest)
                reached = (np.arange(widest) < width[:, None]) & (place < stop)
                place = np.where(reached, place, stop - 1)
                x_at.append(x[place] * reached[:, :, None])
                row_at.append(np.where(reached[:, :, None], own[place - at], ROWS))
                pooled.append(y[best, np.arange(columns)])
                at = stop
        pooled = np.stack(pooled) + self.model.bias
        hidden = _rectified(pooled)
        error = (_sigmoid((hidden @ self.model.out + self.model.base).astype(float)) - label) / len(label)
        back = (error[:, None] * self.model.out * np.where(pooled > 0, 1, LEAK)).astype(np.float32)
        kernel = np.zeros((columns, widest, DIM), np.float32)
        for w, own in enumerate(self.model.kernels):
            kernel[w * FILTERS : (w + 1) * FILTERS, : len(own)] = own.transpose(2, 0, 1)
        moved = back[:, :, None, None] * kernel
        bent = np.einsum("bc,bcod->cod", back, np.stack(x_at))
        grads = [bent[w * FILTERS : (w + 1) * FILTERS, : len(own)].transpose(1, 2, 0).ravel() for w, own in enumerate(self.model.kernels)]
        grad = np.concatenate([*grads, back.sum(axis=0), error @ hidden])
        n, t = len(grad), before + self.step
        m, v = self.dense[n + 1 : 2 * n + 1], self.dense[2 * n + 1 :]
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        self.dense[:n] -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.dense[n] -= self.rate * error.sum()
        rows = np.stack(row_at)
        np.add.at(self.table, rows, -self.rate * moved[:, :, :, None, :])
        self.table[ROWS] = 0
        self.touched[rows] = True
        self.model = unpacked(self.table, self.dense)


def _groups(batch: list[np.ndarray], most: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """The texts of a batch in order, put together up to some words."""
    group, size = [], 0
    for own in batch:
        if group and size + len(own) > most:
            yield group
            group, size = [], 0
        group.append(own)
        size += len(own)
    yield group


def packed(model: Model) -> np.ndarray:
    """The weights of the layers as one vector, with moments of 0."""
    own = np.concatenate([*(k.ravel() for k in model.kernels), model.bias, model.out]).astype(float)
    return np.concatenate([own, [model.base], np.zeros(2 * len(own))])


def unpacked(table: np.ndarray, dense: np.ndarray) -> Model:
    kernels, at = [], 0
    for w in WIDTHS:
        kernels.append(dense[at : at + w * DIM * FILTERS].reshape(w, DIM, FILTERS).astype(np.float32))
        at += w * DIM * FILTERS
    n = FILTERS * len(WIDTHS)
    return Model(table, kernels, dense[at : at + n].astype(np.float32), dense[at + n : at + 2 * n].astype(np.float32), float(dense[at + 2 * n]))


def _sent(at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Sums for some rows of the table, cut into blocks of BLOCK rows."""
    block = at // BLOCK
    cut = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(at)]
    own = [(int(block[a]), at[a:b].astype(np.int32).tobytes(), values[a:b].astype(float).tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in own], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["block", "at", "sums"])


_SENT = "block int, at binary, sums binary"


def _added(sent: DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, sums) of all tasks together, block by block: as many numbers as the model has, whatever the number of texts."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        rows, to = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in group["at"]]), return_inverse=True)
        sums = np.zeros((len(rows), width))
        np.add.at(sums, to, np.concatenate([np.frombuffer(x) for x in group["sums"]]).reshape(-1, width))
        return pd.DataFrame([{"block": group["block"].iloc[0], "at": rows.tobytes(), "sums": sums.tobytes()}])

    for row in sent.groupBy("block").applyInPandas(add, _SENT).collect():
        yield np.frombuffer(row["at"], np.int32), np.frombuffer(row["sums"]).reshape(-1, width)


def evidence(used: DataFrame, yes_all: int, all_: int) -> np.ndarray:
    """Of each row the log-odds of the texts that hold it, drawn to the prior where texts are few. used: t, label of every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((ROWS + 1, 2))
        for batch in batches:
            for at, texts in pieces(batch.column(0), 1 << 20):
                rows, borders = token_rows(texts)
                for i, label in enumerate(batch.column(1).slice(at, len(texts)).to_pylist()):
                    found[np.unique(rows[borders[i] : borders[i + 1] - PAD]), label] += 1
        some = np.flatnonzero(found.any(axis=1))
        yield _sent(some, found[some])

    no, yes = np.zeros(ROWS + 1), np.zeros(ROWS + 1)
    for at, sums in _added(used.select("t", "label").mapInArrow(count, _SENT), 2):
        no[at], yes[at] = sums[:, 0], sums[:, 1]
    prior = yes_all / all_
    return np.log((yes + 4 * prior) / (no + 4 * (1 - prior))) - np.log(prior / (1 - prior))


def train(used: DataFrame, yes: int, n: int, *, shard_rows: int = SHARD_ROWS, rounds: int | None = None, rate: float = 0.02) -> Model:
    """Fit on every text of used (place, doc_id, t, label): n of them, yes of label 1.

    Texts are dealt by hash into shards of about shard_rows. In a round every shard learns from its texts by itself, in small steps from the
    model of the round before; a row of the table takes the mean of the shards that moved it, the layers that of all. A task reads its
    texts one piece after the other and holds the model and one batch of texts; what comes together has the size of the model. Six rounds
    where there is one shard, else three: more texts are more steps.
    """
    shared_by, context = max(1, round(n / shard_rows)), used.sparkSession.sparkContext
    rounds = rounds or (6 if shared_by == 1 else 3)
    model = started(evidence(used, yes, n))
    dense = packed(model)
    steps = -(-n // (BATCH * shared_by))
    dealt = used.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shared_by)).cast("int"))
    for turn in range(rounds):
        shared = context.broadcast((model.table, dense))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, before=turn * steps) -> Iterator[pa.RecordBatch]:
            table, start = shared.value
            learner = Learner(unpacked(table, start), start, rate)
            moved, layers, shards = np.zeros((ROWS + 1, DIM + 1)), np.zeros(len(start)), 0
            texts, labels, now = [], [], None

            def step() -> None:
                if texts:
                    learner.learn(texts, np.array(labels, float), before)
                    texts.clear()
                    labels.clear()

            def close() -> None:
                nonlocal shards
                step()
                if learner.step:
                    some = np.flatnonzero(learner.touched[:ROWS])
                    moved[some, :DIM] += learner.table[some].astype(float) - table[some]
                    moved[some, DIM] += 1
                    layers[:] += learner.dense
                    shards += 1
                learner.reset()

            for batch in batches:
                for at, some in pieces(batch.column(0), 1 << 20):
                    rows, borders = token_rows(some)
                    told, of = batch.column(1).slice(at, len(some)).to_pylist(), batch.column(2).slice(at, len(some)).to_pylist()
                    for i in range(len(some)):
                        if of[i] != now:
                            close()
                            now = of[i]
                        texts.append(rows[borders[i] : borders[i + 1]])
                        labels.append(told[i])
                        if len(texts) == BATCH:
                            step()
            close()
            if shards:
                some = np.flatnonzero(moved[:, DIM])
                yield _sent(some, moved[some])
                # the layers: as rows of the width of the table's, behind its last
                wide = np.r_[layers, shards]
                wide = np.r_[wide, np.zeros(-len(wide) % (DIM + 1))].reshape(-1, DIM + 1)
                yield _sent(LAYERS + np.arange(len(wide)), wide)

        order = dealt.repartition(shared_by, "shard").sortWithinPartitions("shard", F.xxhash64("place", F.lit(turn)), "place", "t")
        table, layers = model.table.copy(), {}
        for at, sums in _added(order.select("t", "label", "shard").mapInArrow(learn, _SENT), DIM + 1):
            if at[0] < LAYERS:
                table[at] += (sums[:, :DIM] / sums[:, DIM:]).astype(np.float32)
            else:
                layers.update(zip(at.tolist(), sums, strict=True))
        wide = np.concatenate([layers[at] for at in sorted(layers)])
        dense = wide[: len(dense)] / wide[len(dense)]
        table[ROWS] = 0
        model = unpacked(table, dense)
        shared.unpersist()
        free(used.sparkSession)
    return model


def calibrated(model: Model, told: list) -> Model:
    """Platt scaling with a weak pull to scale 1. told: z (mean logit), label, n of the bins of all rows kept back from training."""
    z, y, w = (np.array([r[c] for r in told], float) for c in ("z", "label", "n"))
    a, b = 1.0, 0.0
    for _ in range(400 if len(z) else 0):
        p = _sigmoid(a * z + b)
        a -= 0.2 * ((w * (p - y) * z).sum() / w.sum() + 0.01 * (a - 1))
        b -= 0.2 * ((w * (p - y)).sum() / w.sum() + 0.01 * b)
    model.scale, model.shift = max(a, 0.05), b
    return model


def thresholds(scored: DataFrame, least: int = 20) -> DataFrame:
    """lang, threshold: of each language with `least` rows of either label, the threshold of best F1 over all its rows (lang, label, score)."""
    over = [F.count_if(F.col("score") >= float(t)).alias(f"f{i}") for i, t in enumerate(_GRID)]
    hits = [F.count_if((F.col("score") >= float(t)) & (F.col("label") == 1)).alias(f"t{i}") for i, t in enumerate(_GRID)]
    by_lang = scored.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("label").alias("yes"), F.count("*").alias("n"), *over, *hits).where(f"least(yes, n - yes) >= {least}")
    f1 = F.array(*(2 * F.col(f"t{i}") / F.greatest(F.lit(1e-9), F.col(f"f{i}") + F.col("yes")) for i in range(len(_GRID))))
    best = F.filter(F.sequence(F.lit(0), F.lit(len(_GRID) - 1)), lambda i: F.get("f1", i) >= F.array_max("f1") - 1e-9)
    grid = F.array(*(F.lit(float(t)) for t in _GRID))
    return by_lang.withColumn("f1", f1).withColumn("best", best).select("lang", F.get(grid, F.floor(F.size("best") / 2).cast("int")).alias("threshold"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """place, doc_id, t, lang, label, held of every labelled row; a fifth is held back by a hash of the id.

    Bits of the ids' hashes, of a fixed number, go to all tasks first, so that few texts without a label are shuffled.
    """
    bit = F.xxhash64(F.col("doc_id").cast("long")).bitwiseAND(F.lit(BITS - 1))
    word, mask = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    asked = labels.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    some = docs.withColumn("word", word).join(F.broadcast(asked), "word").where(F.col("bits").bitwiseAND(mask) != 0)
    found = some.select("doc_id", "t", "lang").join(labels.hint("merge"), "doc_id")
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    return found.select(F.xxhash64("doc_id").alias("place"), "doc_id", "t", "lang", "label", held.alias("held"))


def fit(docs: DataFrame, labels: DataFrame, **options) -> tuple[Model, DataFrame]:
    """The model and the thresholds by language (lang, threshold), of all labelled rows.

    docs: doc_id, t, lang. labels: doc_id, label (0 or 1), one row per id.
    """
    spark = docs.sparkSession
    with scratch(spark):
        rows = written(labelled(docs, labels), "toxicity-labelled")
        counts = {(r["held"], r["label"]): r["n"] for r in rows.groupBy("held", "label").agg(F.count("*").alias("n")).collect()}
        n, yes, used = sum(counts.values()), counts.get((True, 1), 0) + counts.get((False, 1), 0), counts.get((False, 1), 0)
        of = used + counts.get((False, 0), 0)
        if n < 10 or not 0 < used < of:
            model = Model(np.zeros((ROWS + 1, DIM), np.float32), [], np.zeros(0), np.zeros(0), 0.0, constant=yes / n if n else 0.0)
            return model, spark.createDataFrame([], "lang string, threshold double")
        model = train(rows.where("NOT held"), used, of, **options)
        # on the rows kept back from training alone
        raw = written(_mapped(rows.where("held").select("label", "t", "lang"), model, Model.logits, "label int, lang string, z double"), "toxicity-held")
        near = F.round(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("z"))), 2)
        model = calibrated(model, raw.groupBy(near.alias("bin"), "label").agg(F.avg("z").alias("z"), F.count("*").alias("n")).orderBy("bin", "label").collect())
        score = F.round(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.scale * F.col("z") + model.shift)))), 6)
        return model, written(thresholds(raw.select("label", "lang", score.alias("score"))), "toxicity-thresholds", up=1)


def _mapped(docs: DataFrame, model: Model, measure: Callable, schema: str) -> DataFrame:
    """The first and third column of docs and the model's measure of every whole text, the second."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(1), 1 << 20):
                found = measure(shared.value, *token_rows(texts)).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array(np.round(found, 6), pa.float64())], names)

    return docs.mapInArrow(run, schema)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, score of every whole text of docs (doc_id, t, lang)."""
    return _mapped(docs.select("doc_id", "t", "lang"), model, Model.scores, "doc_id long, lang string, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", default_threshold: float = 0.7, **options) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, of the whole text alone), threshold (of its language), flagged.

    Scores are rounded to 6 digits, below which the arithmetic of a batch shows. Learns from all rows whose id has a label (labels: id and 0/1; nulls are left out, of several the greatest counts). Defined
    results: a null text is empty and scored like any; ids are passed through, null and repeated ones too; a null language has the
    default threshold; without labels of both kinds the score is the labels' mean (0 without labels); an empty table gives no rows;
    other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), safe_text(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    model, by_lang = fit(src, known, **options)
    found = F.coalesce("threshold", F.lit(default_threshold))
    out = score_texts(src, model).join(F.broadcast(by_lang), "lang", "left")
    return out.select("doc_id", "score", found.alias("threshold"), (F.col("score") >= found).alias("flagged"))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    out = toxicity(table(spark, sf_dir, "documents"), labels.where(remainder(F.col("doc_id"), 3) != 1))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("threshold").alias("lang_threshold"), "flagged")
