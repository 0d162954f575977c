"""Candidates of several searches in one form: web results, fusion that carries them along, and what became of each (2.2, 11.4, 11.8, 11.12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.text import candidate_identity, empty_to_null
from ragloom.operators.evidence import richness
from ragloom.operators.retrieval import RRF_K

#: Columns of a candidate besides query_id, rank and score.
FIELDS = ["source_type", "document_id", "chunk_id", "title", "content", "url"]
_TYPES = {"source_type": "string", "document_id": "string", "chunk_id": "string", "title": "string", "content": "string", "url": "string", "rank": "int", "score": "double"}


def _form(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *(F.col(c).cast(t) for c, t in _TYPES.items()))


def local_candidates(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Chunk hits (rank, score, document_id, chunk_id, source_title, file_title, content, enabled) as candidates (2.2).

    The title falls back to the file's where blank. Hits without a chunk id or whose `enabled` is null have no identity or state and are
    left out.
    """
    title = F.coalesce(empty_to_null("source_title"), empty_to_null("file_title"))
    kept = hits.where("chunk_id IS NOT NULL AND enabled IS NOT NULL")
    return _form(kept.select(key, "rank", "score", "document_id", "chunk_id", "content", title.alias("title"), F.lit("local").alias("source_type"), F.lit(None).cast("string").alias("url")), key)


def web_candidates(results: DataFrame, payload: str, key: str = "query_id") -> DataFrame:
    """Results of a web search (a JSON text with `pages`) as candidates (11.8).

    A result without URL or without snippet and content is left out, and keeps its rank to itself; the title falls back to the URL; a
    score that is no JSON number is 0, as is a negative one. A text that is null, no JSON or has no array of pages gives no rows.
    """
    pages = F.from_json(F.col(payload), "pages ARRAY<VARIANT>")["pages"]
    page = results.select(key, F.posexplode(pages).alias("at", "page"))

    def text(name: str) -> Column:
        return empty_to_null(F.try_variant_get("page", f"$.{name}", "string"))

    score = F.try_variant_get("page", "$.score", "variant")
    number = F.schema_of_variant(score).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    value = F.greatest(F.when(number, F.try_variant_get("page", "$.score", "double")).otherwise(0.0), F.lit(0.0))
    none = F.lit(None).cast("string")
    out = page.select(key, (F.col("at") + 1).alias("rank"), F.coalesce(value, F.lit(0.0)).alias("score"), F.lit("web").alias("source_type"), none.alias("document_id"), none.alias("chunk_id"), F.coalesce(text("title"), text("url")).alias("title"), F.coalesce(text("snippet"), text("content")).alias("content"), text("url").alias("url"))
    return _form(out.where("url IS NOT NULL AND content IS NOT NULL"), key)


def fuse_candidates(lists: dict[str, DataFrame], k: int, key: str = "query_id") -> DataFrame:
    """Reciprocal-rank fusion of lists of candidates (11.4): query_id, rank, identity, score, channels and the candidate's fields.

    A list votes once for an identity, by its best rank; the channels are those of all lists, in the order given. Ties go by identity. Of
    an identity's candidates the one with most fields filled stays, of such the one whose JSON text is least. Only identities that get
    into the best k fetch their candidates.
    """
    every = None
    for at, (name, df) in enumerate(lists.items()):
        rows = _form(df, key).withColumn("channel", F.struct(F.lit(at).alias("at"), F.lit(name).alias("name")))
        every = rows if every is None else every.unionByName(rows)
    every = every.withColumn("identity", candidate_identity("source_type", "chunk_id", "url"))
    votes = every.groupBy(key, "identity", "channel").agg(F.min("rank").alias("rank"))
    fused = votes.groupBy(key, "identity").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_list("channel"))["name"], ",").alias("channels"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "identity"))
    best = fused.withColumn("rank", place).where(F.col("rank") <= k)
    own = every.drop("rank").join(best.select(key, "identity"), [key, "identity"], "left_semi")
    row = F.struct(*FIELDS)
    own = own.groupBy(key, "identity").agg(F.min_by(row, F.struct(-richness(FIELDS), F.to_json(F.struct(*sorted(FIELDS)), {"ignoreNullFields": "false"}))).alias("c"))
    return best.join(own, [key, "identity"]).select(key, "rank", "identity", "score", "channels", "c.*")


def channel_hits(lists: dict[str, DataFrame], reranked: DataFrame, cited: DataFrame, key: str = "query_id") -> DataFrame:
    """Every candidate of every list with what became of it, its text as a hash (11.12).

    reranked: query_id, at (order), source_type, chunk_id, url, rerank_score; of several of one identity the last counts. cited:
    query_id, source_type, chunk_id, url. Here a web candidate is its URL as it stands.
    """
    mine = F.struct("source_type", F.coalesce("chunk_id", "url").alias("name"))
    every = None
    for name, df in lists.items():
        rows = _form(df, key).withColumn("channel", F.lit(name))
        every = rows if every is None else every.unionByName(rows)
    every = every.withColumn("_i", mine)
    scores = reranked.withColumn("_i", F.struct("source_type", F.coalesce(F.col("chunk_id").cast("string"), F.col("url")).alias("name")))
    scores = scores.groupBy(key, "_i").agg(F.max_by(F.struct("rerank_score"), "at").alias("_s"))
    marks = cited.select(key, F.struct("source_type", F.coalesce(F.col("chunk_id").cast("string"), F.col("url")).alias("name")).alias("_i")).distinct().withColumn("_c", F.lit(True))
    out = every.join(scores, [key, "_i"], "left").join(marks, [key, "_i"], "left")
    return out.select(key, "channel", "rank", "source_type", "chunk_id", "url", "score", F.col("_s").isNotNull().alias("entered_rerank"), F.col("_c").isNotNull().alias("became_citation"), F.col("_s.rerank_score").alias("rerank_score"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_sha256"))
