"""Named queries over the driver's tables, each with the SQL that it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import access, chunking, metrics, retrieval, sequences
from ragloom.streaming import rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- retrieval -----------------------------------------------------------------------------------------------------------------------------
#: Every vector whose id is divisible by 20 is a query against all others; the second channel is the first 16 components' inner product.
_CHANNELS = """
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 10),
part AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.embedding[1:16]::DOUBLE[], c.embedding[1:16]::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 10)
"""


def _channel(spark: SparkSession, sf_dir: str, name: str, asks: str = "id % 20 = 0") -> DataFrame:
    vector = F.col("embedding") if name == "dense" else F.slice("embedding", 1, 16)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vector.alias("v"))
    return retrieval.dense_top_k(rows.where(asks), rows, 10, cosine=name == "dense")


@query(f"WITH {_CHANNELS} SELECT query_id, rank, vec_id, score FROM dense WHERE rank <= 5")
def dense_cosine_topk(spark, sf_dir):
    return _channel(spark, sf_dir, "dense").where("rank <= 5")


@query(f"""WITH {_CHANNELS}, fused AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(name, ',' ORDER BY name) AS channels
FROM (SELECT query_id, vec_id, rank, 'dense' AS name FROM dense UNION ALL SELECT query_id, vec_id, rank, 'part' FROM part) GROUP BY ALL)
SELECT query_id, vec_id, score, channels, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM fused) WHERE rank <= 5""")
def rrf_fusion_two_channels(spark, sf_dir):
    return retrieval.rrf_fuse({"dense": _channel(spark, sf_dir, "dense"), "part": _channel(spark, sf_dir, "part")}, 5)


@query(f"""WITH {_CHANNELS}, fused AS (SELECT query_id, vec_id, round(sum(p), 9) AS score FROM
(SELECT query_id, vec_id, score * 0.6::DOUBLE AS p FROM dense UNION ALL SELECT query_id, vec_id, score * 0.4::DOUBLE FROM part) GROUP BY ALL)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM fused) WHERE rank <= 5""")
def weighted_fusion(spark, sf_dir):
    return retrieval.weighted_fuse([(_channel(spark, sf_dir, "dense"), 0.6), (_channel(spark, sf_dir, "part"), 0.4)], 5)


#: Every vector asks here.
@query(f"""WITH {_CHANNELS.replace(" WHERE q.vec_id % 20 = 0", "")}, gaps AS (SELECT *, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS below FROM dense WHERE rank <= 5),
cuts AS (SELECT query_id, min(rank) AS cut_at FROM gaps WHERE rank BETWEEN 2 AND 4 AND ((score - below) / (score + 1e-6) > 0.25 OR score - below > 0.25) GROUP BY query_id)
SELECT g.query_id, rank, vec_id, score FROM gaps g LEFT JOIN cuts c USING (query_id) WHERE rank <= coalesce(cut_at, 5)""")
def dynamic_topk_cliff(spark, sf_dir):
    return retrieval.cliff_cut(_channel(spark, sf_dir, "dense", "true"))


@query(f"""WITH {_CHANNELS}, l AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
q AS (SELECT e.vec_id AS query_id, e.label, l.n - 1 AS n_relevant FROM embeddings e JOIN l USING (label) WHERE e.vec_id % 20 = 0),
h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1.0::DOUBLE / log2(rank + 1.0::DOUBLE)) AS dcg FROM dense d JOIN q USING (query_id) JOIN embeddings e ON e.vec_id = d.vec_id AND e.label = q.label WHERE rank <= 5 GROUP BY query_id)
SELECT q.query_id, round(CASE WHEN n_relevant = 0 THEN 1.0 ELSE coalesce(hits, 0)::DOUBLE / n_relevant END, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
round(CASE WHEN n_relevant = 0 THEN 0.0 ELSE coalesce(dcg, 0) / (SELECT sum(1.0::DOUBLE / log2(i + 1.0::DOUBLE)) FROM range(1, 6) t(i) WHERE i <= n_relevant) END, 6) AS ndcg FROM q LEFT JOIN h USING (query_id)""")
def recall_mrr_ndcg(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    queries = rows.where("vec_id % 20 = 0").join(rows.groupBy("label").agg((F.count("*") - 1).alias("n_relevant")), "label")
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), "n_relevant")
    ranked = _channel(spark, sf_dir, "dense").join(rows, "vec_id").join(queries.select("query_id", "own"), "query_id")
    return metrics.ranking_metrics(ranked.withColumn("hit", F.col("label") == F.col("own")), queries.select("query_id", "n_relevant"), 5)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array(" + _LOWER.format("coalesce(text, '')") + r", '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _tokens(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
t AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark),
p AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, doc_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a)) AS w FROM p JOIN f USING (term), s),
r AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM t JOIN w USING (term) GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 5""")
def bm25_topk(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25_top_k(queries, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 5, _tokens)


@query("""SELECT p_partkey, upper(p_type) || p_size || ' ' || upper(p_type) || '-' || p_size || ' ' || upper(p_type) || ' ' || p_size AS variants FROM part""")
def identifier_variants(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.identifier_variants(F.concat_ws(" ", "p_type", "p_size")).alias("variants"))


@query("""WITH v AS (SELECT p_brand || '-' || p_size AS value FROM part), f AS (SELECT value, upper(regexp_replace(value, '[^A-Za-z0-9]', '', 'g')) AS c, count(*) AS frequency FROM v GROUP BY ALL),
q AS (SELECT DISTINCT p_brand || '-' || p_size AS requested FROM part WHERE p_partkey % 20 = 0),
p AS (SELECT requested, f.value, frequency, levenshtein(upper(regexp_replace(requested, '[^A-Za-z0-9]', '', 'g')), c) AS distance FROM q, f WHERE requested <> f.value)
SELECT requested, value, frequency, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY requested ORDER BY distance, frequency DESC, value) AS rank FROM p WHERE distance <= 1) WHERE rank <= 3""")
def levenshtein_suggestions(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", "p_brand", "p_size").alias("value"))
    return retrieval.identifier_suggestions(part.where("p_partkey % 20 = 0"), part.select("value"))


# --- access and state ------------------------------------------------------------------------------------------------------------------------
_VIS = "CASE c_mktsegment WHEN 'BUILDING' THEN 'public' WHEN 'AUTOMOBILE' THEN 'shared' ELSE 'private' END"


@query(f"""SELECT c_custkey, visibility FROM (SELECT *, {_VIS} AS visibility FROM customer) WHERE c_acctbal >= 0 AND c_nationkey IN (1, 2, 3, 4)
AND (visibility = 'public' OR (visibility = 'shared' AND c_nationkey = 3) OR c_custkey = 7)""")
def visibility_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("visibility", F.expr(_VIS)).withColumn("enabled", F.col("c_acctbal") >= 0)
    return access.accessible(rows, [1, 2, 3, 4], tenant_id=3, user_id=7, dataset="c_nationkey", tenant="c_nationkey", owner="c_custkey").select("c_custkey", "visibility")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def disabled_antijoin(spark, sf_dir):
    return access.without(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("toxic = 1"), ["doc_id"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event_override(spark, sf_dir):
    return access.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


@query("""WITH l AS (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN done THEN 'completed' ELSE 'failed' END AS new_status FROM orders LEFT JOIN l ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'""")
def reconcile_tasks(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"))
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("latest_task_id")).agg(F.when(F.bool_and(F.col("l_linestatus") == "F"), "completed").otherwise("other").alias("document_status"))
    return access.reconciled(tasks, docs).select("o_orderkey", "new_status")


# --- histories -------------------------------------------------------------------------------------------------------------------------------
@query("""SELECT conv_id, count(*) AS n_messages, left(arg_max(text, turn), 80) AS preview, left(arg_min(text, turn) FILTER (WHERE role = 'user'), 40) AS title FROM conversations GROUP BY conv_id""")
def conversation_summary(spark, sf_dir):
    return sequences.conversation_summary(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, role, from_end FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations) WHERE from_end <= 8")
def trailing_history(spark, sf_dir):
    return sequences.trailing(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 8)


@query("SELECT event_id, user_id, lag(event_type) OVER w AS previous, row_number() OVER w - 1 AS n_prior FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def prior_action_window(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.lag("event_type").over(w).alias("previous"), (F.row_number().over(w) - 1).cast("long").alias("n_prior"))


@query("SELECT o_orderkey, o_orderpriority, seq FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS seq FROM orders) WHERE seq <= 25")
def quota_admission(spark, sf_dir):
    return sequences.admitted(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 25)


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, position FROM r WHERE n <= 9 OR position IN (SELECT round_even(i * (n - 1) / 8.0::DOUBLE, 0)::BIGINT FROM range(0, 9) t(i))""")
def even_spread_sample(spark, sf_dir):
    return sequences.even_spread(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 9)


@query("""SELECT event_id, user_id, round(CASE WHEN s < 1e-6 THEN 0.0 ELSE (value - m) / (s + 1e-6::DOUBLE) END, 6) AS advantage
FROM events JOIN (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY user_id) USING (user_id)""")
def group_advantage(spark, sf_dir):
    return sequences.group_advantage(table(spark, sf_dir, "events"), "user_id", "value").select("event_id", "user_id", F.round("advantage", 6).alias("advantage"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def sliding_rate_count(spark, sf_dir):
    return rates.sliding_count(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 60).select("event_id", "user_id", "n_recent")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_event_counts(spark, sf_dir):
    return rates.tumbling_counts(table(spark, sf_dir, "events").select("ts", "event_type"), "ts", "event_type")


# --- reports ---------------------------------------------------------------------------------------------------------------------------------
@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def p95_nearest_rank(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("SELECT coalesce(toxic::VARCHAR, 'none') AS toxic, coalesce(quality::VARCHAR, 'none') AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return metrics.confusion_matrix(docs.select("doc_id").join(labels, "doc_id", "left"), "toxic", "quality")


@query("SELECT round(avg(acc), 9) AS macro_accuracy, round(min(acc), 9) AS min_accuracy, count(*) AS buckets FROM (SELECT lang, avg((quality = 1 - toxic)::INT) AS acc FROM documents JOIN labels USING (doc_id) GROUP BY lang)")
def bucket_macro_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    buckets = rows.groupBy("lang").agg(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("int")).alias("acc"))
    return buckets.agg(F.round(F.avg("acc"), 9).alias("macro_accuracy"), F.round(F.min("acc"), 9).alias("min_accuracy"), F.count("*").alias("buckets"))


_SETS = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 9) AS mean_discount FROM {} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"


@query(_SETS.format("lineitem"))
def grouping_sets_summary(spark, sf_dir):
    return spark.sql(_SETS.format("{rows}"), rows=table(spark, sf_dir, "lineitem"))


@query("""SELECT lang, quality, count(l.doc_id) AS n FROM (SELECT DISTINCT lang FROM documents), (SELECT unnest([0, 1]) AS quality) LEFT JOIN
(SELECT doc_id, lang AS g, quality AS v FROM documents JOIN labels USING (doc_id)) l ON g = lang AND v = quality GROUP BY 1, 2""")
def dense_grid_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return metrics.dense_grid(rows, "lang", {"quality": [0, 1]})


@query("SELECT lang, source, n, total, round(n / total, 6) AS share FROM (SELECT lang, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang)::BIGINT AS total FROM documents GROUP BY 1, 2) WHERE n > 0.05 * total")
def share_cap_violations(spark, sf_dir):
    return metrics.share_over(table(spark, sf_dir, "documents"), "lang", "source", 0.05)


@query("""SELECT l_orderkey, l_linenumber, format, cost, round(least(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 0.2 ELSE 1.0 END::DOUBLE, 0.15*format + 0.12*(1 - l_discount) + 0.08*(1 - l_tax) + 0.15 + 0.35 + 0.15*cost), 6) AS total FROM (
SELECT *, (1 - CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 0.65 ELSE 0 END)::DOUBLE AS format, round(greatest(0, 1 - least(0.4, 0.08 * (l_linenumber - 1)) - CASE WHEN l_returnflag = 'A' THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS cost FROM lineitem)""")
def reward_columns(spark, sf_dir):
    c, no = F.col, F.lit(False)
    error = (c("l_linestatus") == "O") & (c("l_returnflag") == "R")
    parts = {"format": metrics.format_score(no, error, no), "retrieval": 1 - c("l_discount"), "citation": 1 - c("l_tax"), "answer": F.lit(1.0), "behaviour": F.lit(1.0), "cost": metrics.cost_score(c("l_linenumber") - 1, c("l_returnflag") == "A", no)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(parts["format"], 6).alias("format"), F.round(parts["cost"], 6).alias("cost"), F.round(metrics.total_reward(parts, error, no), 6).alias("total"))


# --- text ------------------------------------------------------------------------------------------------------------------------------------
@query("SELECT c_custkey, 'subject_' || left(sha1(lower(c_name)), 16) AS subject_id FROM customer")
def subject_id_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.subject_id("c_name").alias("subject_id"))


_RX = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


@query(f"""WITH u AS (SELECT page_id, trim(url) AS u FROM pages), p AS (SELECT page_id, u, regexp_extract(u, '{_RX}', 2) AS host, regexp_replace(regexp_extract(u, '{_RX}', 3), '/+$', '') AS path FROM u),
c AS (SELECT page_id, CASE WHEN u = '' THEN NULL WHEN host <> '' THEN lower(regexp_extract(u, '{_RX}', 1)) || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(u, '{_RX}', 4) ELSE regexp_replace(u, '/+$', '') END AS canonical FROM p)
SELECT canonical, min(page_id) AS page_id, count(*) AS n FROM c GROUP BY canonical""")
def url_canonical_dedup(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.canonical_url("url").alias("canonical")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


_HTML = "coalesce(html, '')"
for _p in ("(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", "(?s)<[^>]*>"):
    _HTML = f"regexp_replace({_HTML}, '{_p}', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"


@query(rf"SELECT page_id, trim(regexp_replace({_HTML}, '\s+', ' ', 'g')) AS text FROM pages")
def html_text_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text("html").alias("text"))


@query("""SELECT n.key_sha1, n.first_doc, n.n FROM (SELECT sha1(k) AS key_sha1, min(doc_id) AS first_doc, count(*) AS n FROM
(SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g') AS k FROM documents) GROUP BY k) n WHERE n.n > 1""".replace("\\\\", "\\"))
def exact_dup_groups(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha1(T.normalise_query("text")).alias("key_sha1"))
    return keyed.groupBy("key_sha1").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")


#: The documents hold no headings: every fifth line becomes one, every ninth a fence.
_MARKED = "CASE WHEN i % 9 = 4 THEN '```' WHEN i % 5 = 2 THEN '## ' || left(l, 20) ELSE l END"


@query(f"""WITH t AS (SELECT doc_id, list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l, i: {_MARKED.replace('i %', '(i - 1) %')}) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS l FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(0, len(ls))) AS i FROM t)),
f AS (SELECT *, starts_with(l, '```') OR starts_with(l, '~~~') AS fence FROM l WHERE l <> ''), o AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS open FROM f),
r AS (SELECT *, sum((NOT fence AND NOT open AND regexp_matches(l, '^#{{1,6}}\\s.+'))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
s AS (SELECT doc_id, run, arg_min(l, i) AS first, string_agg(l, chr(10) ORDER BY i) AS content, run > 0 AND count(*) > 1 AS whole FROM r GROUP BY doc_id, run),
k AS (SELECT * FROM s QUALIFY whole OR (NOT bool_or(whole) OVER (PARTITION BY doc_id) AND run = max(run) OVER (PARTITION BY doc_id)))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS section, CASE WHEN whole THEN first ELSE 'default' END AS title, content FROM k""")
def title_sections(spark, sf_dir):
    marked = F.array_join(F.expr(f"transform(split(regexp_replace(text, '\\r\\n?', '\\n'), '\\n'), (l, i) -> {_MARKED})"), "\n")
    return chunking.title_sections(table(spark, sf_dir, "documents").select("doc_id", marked.alias("text")))


@query()
def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(table(spark, sf_dir, "documents"))


_POLICY = {
    "safety": "toxic = 1", "step": "0", "max_steps": "6", "history_valid": "true", "ended": "false", "subject": "CASE WHEN lang = 'en' THEN 'confirmed' WHEN lang = 'fr' THEN 'ambiguous' WHEN lang = 'de' THEN 'not_found' ELSE 'none' END",
    "subject_known": "true", "realtime": "doc_id % 5 = 0", "local_done": "doc_id % 3 > 0", "hyde_done": "doc_id % 3 = 2", "web_done": "false", "web_allowed": "doc_id % 2 = 0", "last": "CASE doc_id % 3 WHEN 1 THEN 'local' WHEN 2 THEN 'hyde' END",
    "identifier": "'not_applicable'", "evidence_ambiguous": "false", "failed": "doc_id % 7 = 0", "sufficient": "quality = 1", "candidates": "doc_id % 4",
}


@query(f"""WITH s AS (SELECT doc_id, {', '.join(f'{v} AS "{k}"' for k, v in _POLICY.items())} FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN safety THEN 'refuse/safe_guard_triggered' WHEN subject = 'ambiguous' THEN 'ask/subject_ambiguous' WHEN subject = 'none' THEN 'ask/subject_required' WHEN subject = 'not_found' AND NOT realtime THEN 'refuse/subject_not_found'
WHEN realtime THEN CASE WHEN web_allowed THEN 'web/realtime_query' ELSE 'refuse/safe_guard_triggered' END WHEN NOT local_done THEN 'local/initial_local_search'
WHEN failed THEN CASE WHEN web_allowed THEN 'web/action_execution_error' ELSE 'refuse/action_execution_error' END WHEN sufficient THEN 'answer/' || "last" || '_evidence_sufficient'
WHEN "last" = 'local' AND candidates > 0 THEN 'hyde/local_low_score' ELSE CASE WHEN web_allowed THEN 'web/' ELSE 'refuse/' END || CASE WHEN "last" = 'local' THEN 'local_empty' ELSE 'hyde_still_insufficient' END END AS decision FROM s""")
def planner_rule_policy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", *(F.expr(v).alias(k) for k, v in _POLICY.items()))
    return rows.select("doc_id", metrics.rule_policy().alias("decision"))


from ragloom.plans import answers, curation, indexes, inventory  # noqa: E402, F401  register their queries
