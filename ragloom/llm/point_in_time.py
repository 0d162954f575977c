"""Operator 12, point-in-time feature join by a persistent ordered tree.

A version is usable from its start (event and arrival both past) until its expiry. Within a key these starts and expiries are edits in
time; each edit copies the path from the root to one leaf of a tree ordered by rank (event, then earlier arrival, then id), so every
moment keeps a root of its own. A question binary-searches the root of its time and reads the greatest rank below it.

Time is cut into slabs, so that a hot key takes as many tasks as it has slabs. A version goes as edits to the slabs of its start and of its
end; the slabs that it covers whole are named by a few dyadic nodes, of which only the greatest version is kept, with map-side combine.
Versions of one key, start and expiry are reduced to the greatest, and questions to distinct (key, t), before anything is shuffled, so a
slab holds no more than its seconds allow, however many rows there are.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.common import parallelism, scratch, table, written

#: Whole seconds of a slab: one (key, slab) is the unit of work, no result depends on it.
SLAB = 32


class ActiveTree:
    """Ordered binary tree over ranks 0 to n - 1; `edit` returns a new root and leaves every older root as it was."""

    def __init__(self, n: int) -> None:
        self.bits = max(1, (n - 1).bit_length())
        # node 0 is the empty tree, node 1 + r the leaf of rank r
        self.left, self.right = array("q", [0]) * (n + 1), array("q", [0]) * (n + 1)
        self.most = array("q", range(-1, n))

    def edit(self, root: int, rank: int, active: bool) -> int:
        """The tree `root` with `rank` in it (active) or without."""
        path, node = [], root
        for bit in range(self.bits - 1, -1, -1):
            path.append(node)
            node = self.right[node] if rank >> bit & 1 else self.left[node]
        new = 1 + rank if active else 0
        for bit in range(self.bits):
            old = path.pop()
            low, high = (self.left[old], new) if rank >> bit & 1 else (new, self.right[old])
            if not low and not high:
                new = 0
                continue
            self.left.append(low)
            self.right.append(high)
            self.most.append(self.most[high] if high else self.most[low])
            new = len(self.most) - 1
        return new


def winners(spans: list[tuple[int, int]], asked: list[int]) -> list[int]:
    """For each time asked, the greatest i with spans[i][0] <= time < spans[i][1], or -1. spans: in rising order of rank."""
    edits = sorted([(start, 1, i) for i, (start, end) in enumerate(spans) if start < end] + [(end, 0, i) for i, (start, end) in enumerate(spans) if start < end])
    tree, root, times, roots = ActiveTree(len(spans)), 0, [], []
    for at, active, rank in edits:
        root = tree.edit(root, rank, bool(active))
        if times and times[-1] == at:
            roots[-1] = root
        else:
            times.append(at)
            roots.append(root)
    found = (bisect_right(times, t) - 1 for t in asked)
    return [tree.most[roots[i]] if i >= 0 else -1 for i in found]


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, slab, is a question, version) to (key, t, version); one slab is held at a time."""
    group, spans, held, asked, schema = None, [], [], [], None

    def flush() -> Iterator[pa.RecordBatch]:
        if spans and asked:
            rows = [(t, w) for t, w in zip(asked, winners(spans, asked), strict=True) if w >= 0]
            if rows:
                best = pa.array([held[w] for _, w in rows], schema.field("best").type)
                yield pa.RecordBatch.from_arrays([pa.array([group[0]] * len(rows), schema.field("key").type), pa.array([t for t, _ in rows], pa.int64()), best], ["key", "t", "best"])

    for batch in batches:
        schema = batch.schema
        columns = [batch.column(c).to_pylist() for c in ("key", "slab", "ask", "start", "expiry", "best")]
        for key, slab, ask, start, expiry, best in zip(*columns, strict=True):
            if group != (key, slab):
                yield from flush()
                group, spans, held, asked = (key, slab), [], [], []
            if ask:
                asked.append(start)
            else:
                spans.append((start, expiry))
                held.append(best)
    yield from flush()


def point_in_time(asks: DataFrame, versions: DataFrame, *, key: str, slab_seconds: int = SLAB) -> DataFrame:
    """`asks` (key, t and any other columns) with `version`: a struct (event, arrival, version_id, payload) of the winner, or null.

    versions: key, event, arrival, expiry, version_id (whole seconds and ids, long) and payload, any orderable column. Usable at t: the
    same key, event <= t and arrival <= t < expiry. The latest event wins, then the earliest arrival, then the largest id.

    Defined results: null keys and times match nothing; a version with a null key, time or id takes no part, nor one that expires before
    it starts; of rows that are equal but for the payload the greatest payload counts; repeated asks are answered each; empty tables give
    null versions or no rows. `asks` must not have a column `version`; other columns pass through and are not read.
    """
    spark, width = asks.sparkSession, slab_seconds
    with scratch(spark):
        best = F.struct("event", (-F.col("arrival")).alias("neg_arrival"), "version_id", "payload")
        usable = versions.select(F.col(key).alias("key"), F.greatest("event", "arrival").alias("start"), "expiry", best.alias("best")).where("key IS NOT NULL AND best.event IS NOT NULL AND best.neg_arrival IS NOT NULL AND best.version_id IS NOT NULL AND start < expiry")
        slab_of = f"({{0}} - pmod({{0}}, {width}L)) div {width}L"
        spans = usable.groupBy("key", "start", "expiry").agg(F.max("best").alias("best"))
        spans = written(spans.withColumns({"first": F.expr(slab_of.format("start")), "last": F.expr(slab_of.format("(expiry - 1)"))}), "spans")
        points = written(asks.select(F.col(key).alias("key"), F.col("t").cast("long").alias("t")).where("key IS NOT NULL AND t IS NOT NULL").distinct().withColumn("slab", F.expr(slab_of.format("t"))), "points")

        # the slabs between a version's first and last, as dyadic nodes: a node counts where the one above it is not covered whole
        whole = spans.where("last - first > 1").select("key", "best", F.expr("first + 1").alias("a"), F.col("last").alias("b"))  # a to b - 1
        level = "CAST(l AS INT)"
        nodes = f"""flatten(transform(sequence(0L, CAST(floor(log2(b - a)) AS BIGINT)), l -> filter(array(
            IF(-shiftright(-a, {level}) < shiftright(b, {level}) AND pmod(-shiftright(-a, {level}), 2) = 1, struct(l AS level, -shiftright(-a, {level}) AS node), NULL),
            IF(-shiftright(-a, {level}) < shiftright(b, {level}) AND pmod(shiftright(b, {level}) - 1, 2) = 0, struct(l AS level, shiftright(b, {level}) - 1 AS node), NULL)), x -> x IS NOT NULL)))"""
        covered = whole.select("key", "best", F.explode(F.expr(nodes)).alias("n")).groupBy("key", "n.level", "n.node").agg(F.max("best").alias("best"))
        longest = spans.agg(F.max(F.expr("last - first"))).first()[0] or 0  # one number
        above = F.expr(f"explode(transform(sequence(0L, {max(longest, 1).bit_length()}L), l -> struct(l AS level, shiftright(slab, {level}) AS node)))")
        over = points.select("key", "slab").distinct().select("key", "slab", above.alias("n")).select("key", "slab", "n.level", "n.node")
        covers = over.join(covered, ["key", "level", "node"]).groupBy("key", "slab").agg(F.max("best").alias("best"))

        edge = F.expr("explode(array_distinct(array(first, last)))")
        edges = spans.select("key", "start", "expiry", "best", edge.alias("slab")).select("key", "slab", F.lit(False).alias("ask"), "start", "expiry", "best")
        rows = edges.unionByName(covers.select("key", "slab", F.lit(False).alias("ask"), (F.col("slab") * width).alias("start"), ((F.col("slab") + 1) * width).alias("expiry"), "best"))
        rows = rows.unionByName(points.select("key", "slab", F.lit(True).alias("ask"), F.col("t").alias("start"), F.lit(None).cast("long").alias("expiry"), F.lit(None).cast(spans.schema["best"].dataType).alias("best")))
        dealt = rows.repartition(parallelism(spark), "key", "slab").sortWithinPartitions("key", "slab", "ask", "best")
        schema = asks.select(F.col(key).alias("key"), F.lit(0).cast("long").alias("t")).schema.add("best", spans.schema["best"].dataType)
        answers = written(dealt.mapInArrow(_answers, schema), "answers", up=1)
    version = F.when(F.col("_best").isNotNull(), F.struct(F.col("_best.event").alias("event"), (-F.col("_best.neg_arrival")).alias("arrival"), F.col("_best.version_id").alias("version_id"), F.col("_best.payload").alias("payload")))
    found = answers.select(F.col("key").alias("_key"), F.col("t").alias("_t"), F.col("best").alias("_best"))
    return asks.join(found, (F.col(key) == F.col("_key")) & (F.col("t") == F.col("_t")), "left").select(*asks.columns, version.alias("version"))


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every `labels` row with the version of its document's source that was usable at its time.

    A row without an id has no time; of several documents of one id the least source asks.
    """

    def number(group: int) -> F.Column:
        return F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 8 * group + 1, 8), 16, 10).cast("long")

    docs = table(spark, sf_dir, "documents")
    event = number(0) % 20000
    versions = docs.select("source", event.alias("event"), (event - 60 + number(1) % 300).alias("arrival"), (event + number(2) % 900).alias("expiry"), F.col("doc_id").alias("version_id"), F.struct("n_chars", "lang").alias("payload"))
    sources = docs.groupBy("doc_id").agg(F.min("source").alias("source"))
    asks = table(spark, sf_dir, "labels").select("doc_id", (number(3) % 20000).alias("t")).join(sources, "doc_id", "left")
    out = point_in_time(asks, versions, key="source")
    age = F.col("t") - F.col("version.event")
    status = F.when(F.col("version").isNull(), "none").when(age > 60, "stale").otherwise("fresh")
    fresh = F.col("status") == "fresh"
    return out.select("doc_id", "t", F.col("version.version_id").alias("version_id"), age.alias("age"), status.alias("status"), "version.payload").select(
        "doc_id", "t", "version_id", "age", "status", F.when(fresh, F.col("payload.n_chars")).alias("n_chars"), F.when(fresh, F.col("payload.lang")).alias("lang")
    )


OP12_SQL = """
WITH d AS (SELECT *, sha256(CAST(doc_id AS VARCHAR)) AS x FROM documents),
v AS (SELECT doc_id, source, n_chars, lang, CAST('0x' || x[1:8] AS BIGINT) % 20000 AS event,
    CAST('0x' || x[1:8] AS BIGINT) % 20000 - 60 + CAST('0x' || x[9:16] AS BIGINT) % 300 AS arrival,
    CAST('0x' || x[1:8] AS BIGINT) % 20000 + CAST('0x' || x[17:24] AS BIGINT) % 900 AS expiry FROM d),
a AS (SELECT l.doc_id, s.source, CAST('0x' || sha256(CAST(l.doc_id AS VARCHAR))[25:32] AS BIGINT) % 20000 AS t
  FROM labels l LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY 1) s ON s.doc_id = l.doc_id),
w AS (SELECT q.source, q.t, v.doc_id AS version_id, q.t - event AS age, n_chars, lang FROM (SELECT DISTINCT source, t FROM a) q
  JOIN v ON v.source = q.source AND event <= q.t AND arrival <= q.t AND q.t < expiry
  QUALIFY row_number() OVER (PARTITION BY q.source, q.t ORDER BY event DESC, arrival, v.doc_id DESC, n_chars DESC NULLS LAST, lang DESC NULLS LAST) = 1)
SELECT a.doc_id, a.t, version_id, age, CASE WHEN version_id IS NULL THEN 'none' WHEN age > 60 THEN 'stale' ELSE 'fresh' END AS status,
  CASE WHEN age <= 60 THEN n_chars END AS n_chars, CASE WHEN age <= 60 THEN lang END AS lang
FROM a LEFT JOIN w ON a.source = w.source AND a.t = w.t
"""
