"""Operator 5, MinHash near-duplicates by an inverted join over signature coordinates.

Documents with equal shingle sets form a class; one node stands for it. A node is posted under its (coordinate, value) pairs. Two nodes
whose signatures agree in m of COORDINATES places (least_match) share a pair among the COORDINATES - m + 1 rarest of either (prefix), so only
these posting lists are joined; the longer lists are never merged: the sketch that every posting carries gives the remaining collisions
(skip). Pairs at or above m are confirmed on the full sets. What lies in one list but in different components after that must, besides,
share one of its rarest shingles, an exact bound that keeps documents with a common passage apart.

Components are made from the lists without expanding any into all its pairs (linking.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.common import asked, free, one_of_each, row_mark, safe_text, scratch, table, written
from ragloom.llm.linking import linked_components
from ragloom.llm.text_arrays import mix, pieces, word_hashes

_U = np.uint64
COORDINATES = 64
#: How likely a pair exactly at the threshold may fall below least_match.
MISS = 1e-6
#: Longs of a sketch: 16 bits of each coordinate, coordinate c in long c // 4.
_LANES = COORDINATES // 4
_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, (COORDINATES, 2), dtype=np.uint64) | _U(1)


def least_match(percent: int) -> int:
    """The most coordinates that a pair at a similarity of percent agrees in with a probability of at least 1 - MISS."""
    p, below = percent / 100, 0.0
    for m in range(COORDINATES + 1):
        below += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if below > MISS:
            break
    if not m:
        raise ValueError(f"{COORDINATES} coordinates cannot find pairs at {percent} percent with a miss rate of {MISS}")
    return m


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text, one text after the other, their borders)."""
    words, first, count = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), count)
    hashes = words
    if len(words):
        for k in range(1, size):
            hashes = mix(hashes * _U(0xD6E8FEB86659FD93) + np.r_[words[k:], np.zeros(min(k, len(words)), np.uint64)])
        last = first + count - 1
        whole = np.arange(len(words)) + size - 1 <= np.repeat(last, count)
        # a text of fewer words is one shingle: all its words, folded; the number of words keeps it apart from full shingles
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            folded = words[first[short]] + _U(1)
            for k in range(1, size - 1):
                has = count[short] > k
                folded[has] = mix(folded[has] * _U(0xD6E8FEB86659FD93) + words[first[short][has] + k])
            hashes = hashes.copy()
            hashes[first[short]] = mix(folded + count[short].astype(np.uint64))
            whole[first[short]] = True
        hashes, doc = hashes[whole], doc[whole]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(hashes) else np.zeros(0, bool)
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def _signatures(sets: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """(texts with a shingle, COORDINATES) minima; texts without one are left out."""
    starts = borders[:-1][np.diff(borders) > 0]
    out = np.empty((len(starts), COORDINATES), np.uint64)
    for i, (a, b) in enumerate(_SEEDS):
        out[:, i] = np.minimum.reduceat(sets * a + b, starts) if len(starts) else 0
    return out


def _sized(borders: np.ndarray) -> np.ndarray:
    return np.diff(borders).astype(np.int64)


def _fingerprints(sets: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(sets + _U(7)))]
    return mix(sums[borders[1:]] - sums[borders[:-1]] + np.diff(borders).astype(np.uint64)).view(np.int64)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node (fingerprint of the set), key (array of posting keys), sketch (array of 4 coordinates a long), mark (as given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(1)):
                sets, borders = shingle_sets(texts, size)
                n = _sized(borders)
                full = np.flatnonzero(n > 0)
                keys = np.zeros((len(texts), COORDINATES), np.uint64)
                keys[full] = _signatures(sets, borders)
                sketch = np.ascontiguousarray(mix(keys).astype(np.uint16)).view(np.int64)
                keys = mix(keys + np.arange(COORDINATES, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)

                def lists(values: np.ndarray) -> pa.Array:
                    width = values.shape[1]
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(values.ravel()))

                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n), pa.array(_fingerprints(sets, borders)), lists(keys), lists(sketch), batch.column(2).slice(at, len(texts))], ["doc_id", "n_shingles", "node", "key", "sketch", "mark"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, key array<long>, sketch array<long>, mark long")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """node, set (binary: sorted 64-bit shingle hashes) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(1)):
                sets, borders = shingle_sets(texts, size)
                yield pa.RecordBatch.from_arrays([pa.array(_fingerprints(sets, borders)), pa.array([sets[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)], pa.binary())], ["node", "set"])

    return docs.mapInArrow(run, "node long, set binary")


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """node, size, shingle, place (from 0): the first of every set's shingles in one order for all sets, the rarest of these sets first.

    As many as it takes: sets of a similarity of percent share one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(1).cast(pa.large_binary())
            borders = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
            nodes = np.repeat(batch.column(0).to_numpy(), np.diff(borders) // 8)
            values = np.frombuffer(packed.buffers()[2], np.uint8)[borders[0] : borders[-1]].view(np.int64)
            for at in range(0, len(values), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 18)]), pa.array(values[at : at + (1 << 18)])], ["node", "shingle"])

    seen = sets.select("node", "set").mapInArrow(run, "node long, shingle long")
    counts = seen.groupBy("shingle").agg(F.count("*").alias("sets"))
    ordered = seen.join(counts, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("all"))
    size = F.size("all")
    take = size - F.ceil(size * percent / 100).cast("int") + 1
    return ordered.select("node", size.alias("size"), F.posexplode(F.slice("all", 1, take)).alias("place", "t")).select("node", "size", "place", "t.shingle")


def agreement(left: list[Column], right: list[Column]) -> Column:
    """One bit for each coordinate on which the sketches agree; by chance 1 in 65,536 of the others does too."""
    out = F.lit(0).cast("long")
    for lane, (x, y) in enumerate(zip(left, right, strict=True)):
        differ = x.bitwiseXOR(y)
        for bits in (8, 4, 2, 1):
            differ = differ.bitwiseOR(F.shiftrightunsigned(differ, bits))
        out = out.bitwiseOR(F.shiftleft(F.bitwise_not(differ).bitwiseAND(F.lit(0x0001000100010001)), lane))
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * |intersection| >= percent * |union|."""
    found = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["set_a"], frame["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield frame.loc[keep, ["a", "b"]]

    return found.mapInPandas(run, "a long, b long")


def linked_nodes(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows with doc_id, n_shingles, node and mark (row_mark), and (node, label) of the nodes with a link."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), safe_text(text_col).alias("t"), row_mark(id_col, text_col).alias("mark"))
    rows = written(signed(src, shingle_words), "near-signed")
    lanes, match = [f"s{i}" for i in range(_LANES)], least_match(percent)
    # sets of fewer than four shingles can only be linked by equality: 3 of 4 is below 80 in 100 (checked for the given percent)
    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))
    nodes = rows.where(f"n_shingles >= {least}").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("key").alias("key"), F.first("sketch").alias("sketch"))
    nodes = nodes.select("node", "n", "key", *(F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(_LANES)))
    nodes = written(nodes, "near-nodes")

    posted = nodes.select("node", F.explode("key").alias("key"))
    frequent = written(posted.groupBy("key").count().where("count > 1"), "near-lists")
    # the prefix: the rarest pairs of a node; a pair of its own only takes a place in it
    ranked = posted.join(frequent, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("common"))
    take = F.lit(COORDINATES - match + 1) - (F.lit(COORDINATES) - F.size("common"))
    # a node is as typical as the lists of all its pairs are long
    rank = F.aggregate("common", F.lit(0).cast("long"), lambda n, t: n + t["count"])
    prefix = ranked.where(take > 0).select("node", rank.alias("rank"), F.explode(F.slice("common", 1, F.greatest(take, F.lit(1)))).alias("t")).select("node", "rank", "t.key")
    lists = written(prefix.join(nodes.select("node", "n", *lanes), "node"), "near-prefix")
    free(docs.sparkSession)

    def agreed(x: str, y: str) -> Column:
        return agreement([F.col(f"{x}.{lane}") for lane in lanes], [F.col(f"{y}.{lane}") for lane in lanes])

    def likely(x: str, y: str) -> Column:
        sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
        return sizes & (F.bit_count(agreed(x, y)) >= match)

    # a set is needed once for each node: from the document of smallest id in the class
    named = rows.where(f"n_shingles >= {least}").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    pool: list[DataFrame] = []

    def load(wanted: DataFrame) -> None:
        for known in pool:
            wanted = wanted.join(known.select("node"), "node", "left_anti")
        wanted = written(wanted, "near-wanted")
        if not wanted.isEmpty():
            ids = wanted.join(named, "node").select("doc_id").distinct()
            # before the join, so that texts not asked for are not shuffled
            own = asked(src, ids, "doc_id")
            own = own.join(ids, own["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
            pool.append(written(full_sets(own, shingle_words).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "near-sets"))

    def confirm(pairs: DataFrame) -> DataFrame:
        load(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        if not pool:
            return pairs.limit(0)
        return confirmed(pairs, reduce(DataFrame.unionByName, pool), percent)

    def rest(left: DataFrame) -> DataFrame:
        left = written(left, "near-left-nodes")
        load(left.select("node"))
        firsts = rare_shingles(reduce(DataFrame.unionByName, pool).join(left.select("node"), "node", "left_semi"), percent)
        firsts = written(firsts.join(left.select("node", "label", "leads"), "node"), "near-rare")
        # of the shared shingles the first in the common order has nothing shared before it, so the intersection is within both rests
        most = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
        meets = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & ((100 + percent) * most >= percent * (F.col("x.size") + F.col("y.size")))
        return firsts.where("leads").alias("x").join(firsts.alias("y"), meets)

    return rows, linked_components(lists, ["n", *lanes], likely, confirm, "near", rest)


def near_dup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    A set is the distinct shingle_words-word shingles of the whole text, or all words as one shingle where there are fewer. Defined
    results: a text that is null or has no words has an empty set and no links; equal sets are linked whatever their number; a null
    doc_id is reachable but names no component (a component of nulls alone has component_id null); kept is false for it unless the
    component is null too; repeated rows are documents of one class and keep one shared verdict; an empty table gives no rows; other
    columns are not read. Links below the sketch threshold by chance (least_match: probability at most MISS at exactly percent, less
    above) are the only ones that can be missed, and only where no other path connects the two.
    """
    with scratch(docs.sparkSession):
        rows, labels = linked_nodes(docs, id_col, text_col, shingle_words, percent)
        classes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        lowest = classes.groupBy("label").agg(F.min("low").alias("component_id"))
        named_class = classes.join(lowest, "label").select("node", "component_id")
        out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(named_class, "node", "left")
        out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        # the verdicts alone stay; sets, sketches and lists go with the block
        out = written(out, "near-verdicts", up=1)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` less all but one of each component, whatever their ids; rows without words stay.

    Decided by row, not by doc_id: the row of smallest doc_id stays (nulls last, then by row_mark), one of those with equal id and text.
    """
    with scratch(docs.sparkSession):
        rows, labels = linked_nodes(docs, id_col, text_col, shingle_words, percent)
        full = rows.where("n_shingles > 0").select("doc_id", "mark", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        first = full.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("first"))
        stay = written(first.select(F.col("first.mark").alias("_mark")), "near-stay")
        marks = full.select(F.col("mark").alias("_mark"))
        gone = written(marks.join(stay, "_mark", "left_anti").distinct(), "near-gone", up=1)
        twins = marks.join(stay, "_mark", "left_semi").groupBy("_mark").count().where("count > 1").select("_mark")
        twins = written(twins, "near-twins", up=1)
    left = docs.withColumn("_mark", row_mark(id_col, text_col)).join(gone, "_mark", "left_anti")
    return one_of_each(left, twins, "_mark").select(*docs.columns)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


_W = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, w.doc_id = min(r.c) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""
