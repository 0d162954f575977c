"""Named queries over stored indexes, each with its SQL over the whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ragloom.operators import dense_index, lexical_index
from ragloom.plans.catalogue import query, table
from ragloom.plans.storage import shared_folder

# --- lexical index (7.4, 9.5, 9.7) -----------------------------------------------------------------------------------------------------------


def _token_sql(text: str) -> str:
    """DuckDB: the analyzer's tokens of `text`; the characters of Han runs are taken by place."""
    runs = rf"regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{M}}\p{{N}}]+')"
    parts = rf"flatten(list_transform({runs}, lambda r: regexp_extract_all(r, '\p{{Han}}+|[^\p{{Han}}]+')))"
    return rf"flatten(list_transform({parts}, lambda r: CASE WHEN regexp_matches(r, '^\p{{Han}}{{2}}') THEN list_transform(range(1, length(r)), lambda i: r[i:i+1]) ELSE [r] END))"


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(f"""WITH d AS (SELECT doc_id, unnest({_token_sql('text')}) AS term FROM documents), l AS (SELECT doc_id, count(*) AS len FROM d GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len) AS a FROM l), p AS (SELECT term, doc_id, len, count(*) AS tf FROM d JOIN l USING (doc_id) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
t AS (SELECT DISTINCT page_id AS query_id, unnest({_token_sql(_TITLE)}) AS term FROM pages),
w AS (SELECT term, doc_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a)) AS w FROM p JOIN f USING (term), s),
r AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM t JOIN w USING (term) GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")
def lexical_index_topk(spark, sf_dir):
    """The titles of all pages as queries against an index of all documents."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = lexical_index.build_index(documents, f"{shared_folder(spark)}/ragloom/lexical-index-{uuid.uuid4().hex}")
    return lexical_index.search_index(index, table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.expr(_TITLE).alias("text")), 10)


@query(f"""WITH d AS (SELECT lang, {_token_sql('text')} AS t FROM documents), u AS (SELECT lang, unnest(t) AS term FROM d)
SELECT lang, n_documents, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_terms, 0) AS n_terms FROM (SELECT lang, count(*) AS n_documents FROM d GROUP BY ALL)
LEFT JOIN (SELECT lang, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM u GROUP BY ALL) USING (lang)""")
def analyzer_tokens_by_lang(spark, sf_dir):
    lexical_index.check_analyzer(spark)
    rows = table(spark, sf_dir, "documents").select("lang", F.explode_outer(lexical_index.analyze(F.col("text"))).alias("term"))
    terms = rows.groupBy("lang", "term").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n")).otherwise(0)).alias("n_tokens"), F.count("term").alias("n_terms"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_documents")).join(terms, "lang").select("lang", "n_documents", "n_tokens", "n_terms")



_FIELDS = "[name, brand, kind, 'size ' || size]"
_SPELT = r"'\b([A-Z]{1,12})[\s_-]*(\d[A-Z0-9]*(?:[-_]+[A-Z0-9]+)*)\b'"


@query(rf"""WITH f AS (SELECT item_id, list_filter(list_transform({_FIELDS}, lambda x: trim(regexp_replace(coalesce(x, ''), '\s+', ' ', 'g'))), lambda x: x <> '') AS v FROM items),
b AS (SELECT item_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), chr(10)) AS body FROM f),
m AS (SELECT item_id, body, flatten(list_transform(list_zip(regexp_extract_all(upper(body), {_SPELT}, 1), regexp_extract_all(upper(body), {_SPELT}, 2)),
  lambda z: list_transform(['', '-', ' '], lambda c: z[1] || c || regexp_replace(z[2], '[_-]', '', 'g')))) AS n FROM b),
s AS (SELECT item_id, body, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ' ') AS names FROM m)
SELECT item_id, CASE WHEN names = '' THEN body WHEN body = '' THEN names ELSE body || chr(10) || names END AS index_text FROM s""")
def lexical_index_texts(spark, sf_dir):
    fields = (F.col("name"), F.col("brand"), F.col("kind"), F.concat(F.lit("size "), F.col("size")))
    return table(spark, sf_dir, "items").select("item_id", lexical_index.lexical_text(*fields).alias("index_text"))


# --- dense index (7.2) -----------------------------------------------------------------------------------------------------------------------
@query("""SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""")
def dense_index_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = dense_index.build_index(rows, f"{shared_folder(spark)}/ragloom/dense-index-{uuid.uuid4().hex}")
    return dense_index.search_index(index, rows.where("id % 20 = 0"), 10)
