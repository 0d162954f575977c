"""A stored lexical index: analyzer, index text, term-partitioned postings in blocks with their greatest weights, exact BM25 top k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators.retrieval import top_k
from ragloom.operators.sparse_blocks import block_top_k
from ragloom.plans.storage import free, stored, stored_for

#: Fixed value: the longest index text.
TEXT_CAP = 65_535
#: Folders of terms; a query reads those of its terms.
BUCKETS = 64
#: Documents of a shard on average. A shard holds documents of like length, whose weights are alike, so its greatest ones say much.
SHARD_ROWS = 32
#: Length classes per doubling of the length.
CLASSES = 8
#: Shards whose documents are scored first, by what their terms may add up to: this many for every row asked for.
FIRST = 4
#: Documents of a file on average.
FILE_ROWS = 1 << 20
#: Scores are rounded to 6 digits: what may still round to the k-th score stays.
SLACK = 2e-6


# --- analyzer and index text (9.5, 9.7) ------------------------------------------------------------------------------------------------------
def analyze(text: Column) -> Column:
    """Lower-case tokens: runs of letters, marks and digits; runs of Han characters as their bigrams, single ones as they are."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    parts = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(r"\p{IsHan}+|[^\p{IsHan}]+"), F.lit(0))))
    pairs = lambda r: F.regexp_extract_all(r, F.lit(r"(?=(..))."), F.lit(1))
    return F.flatten(F.transform(parts, lambda r: F.when(r.rlike(r"^\p{IsHan}{2}"), pairs(r)).otherwise(F.array(r))))


def check_analyzer(spark: SparkSession, tokens=analyze) -> list[str]:
    """The tokens of a sample with codes and Han text; a ValueError names what an analyzer loses, before any index is built with it (9.7)."""
    found = spark.range(1).select(tokens(F.lit("Pump RX450 报警 E117 温度传感器")).alias("t")).first()["t"]
    lost = [t for t in ("rx450", "e117") if t not in found]
    if not any("一" <= c <= "鿿" for t in found for c in t):
        lost.append("Han text")
    if lost:
        raise ValueError(f"the analyzer loses {', '.join(lost)}")
    return found


def lexical_text(*fields: Column, cap: int = TEXT_CAP) -> Column:
    """Index text of a record (9.5): distinct non-blank fields in order, a line each, then all spellings of their identifiers.

    Over `cap` characters the identifiers stay and the fields give way; null fields are blank.
    """
    lines = F.array_distinct(F.filter(F.array(*(T.collapse_spaces(f) for f in fields)), lambda x: x != ""))

    def joined(body: Column) -> Column:
        def capped(names: Column) -> Column:
            room = F.lit(cap - 1) - F.length(names)
            cut = F.when(room > 0, F.concat(F.rtrim(F.left(body, room)), F.lit("\n"), names)).otherwise(F.right(names, F.lit(cap)))
            whole = F.when(body == "", names).otherwise(F.concat(body, F.lit("\n"), names))
            return F.when(names == "", F.rtrim(F.left(body, F.lit(cap)))).when(F.length(whole) <= cap, whole).otherwise(cut)

        return T.let(T.identifier_variants(body), capped)

    return T.let(F.array_join(lines, "\n"), joined)


# --- index (7.4) -----------------------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class LexicalIndex:
    """`terms`: bucket, term, df. `blocks`: bucket, term, shard, n, top and postings (doc_id, w), w without idf. `documents`: how many."""

    terms: DataFrame
    blocks: DataFrame
    documents: int


def _written(df: DataFrame, path: str) -> None:
    df.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def build_index(documents: DataFrame, path: str, tokens=analyze, *, k1: float = 1.2, b: float = 0.75) -> LexicalIndex:
    """Write the index of documents (id, text) below `path` and open it.

    Rows of one id are one document; rows without an id and documents without a token take no part. Texts are read once: term counts
    are stored, lengths and weights come from them. Files are sorted by term, so that a scan skips row groups by it.
    """
    spark = documents.sparkSession
    words = documents.where("id IS NOT NULL").select(F.col("id").alias("doc_id"), tokens(F.col("text")).alias("words"))
    words = words.withColumn("len", F.sum(F.size("words")).over(Window.partitionBy("doc_id")))
    # still partitioned by document: no second shuffle
    counts = words.select("doc_id", "len", F.explode("words").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    with stored_for(counts, "lexical-counts") as counts:
        free(spark)
        lengths = counts.select("doc_id", "len").distinct()
        n, mean = lengths.agg(F.count("*"), F.avg("len")).first()
        # a class of lengths has as many shards as it has rows for; there are at most CLASSES * 64 classes
        of_length = F.floor(F.log2("len") * CLASSES).cast("long")
        shards = stored(lengths.groupBy(of_length.alias("class")).agg(F.ceil(F.count("*") / SHARD_ROWS).alias("shards")), "lexical-shards")
        sent = counts.join(F.broadcast(shards), of_length == F.col("class")).select("doc_id", "term", "tf", "len", "shards")
        weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean or 1.0)))
        shard = F.shiftleft(of_length, 40).bitwiseOR(F.pmod(F.xxhash64("doc_id"), F.col("shards")))
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        # a folder has one file for every million documents; blocks are made where they are written, and what follows from a row is not sent
        file = F.pmod(F.xxhash64(shard), F.lit(-(-n // FILE_ROWS) or 1))
        postings = sent.repartition(bucket, file).select(bucket.alias("bucket"), "term", "doc_id", weight.alias("w"), shard.alias("shard"), file.alias("file"))
        blocks = postings.groupBy("bucket", "file", "term", "shard").agg(F.count("*").alias("n"), F.max("w").alias("top"), F.sort_array(F.collect_list(F.struct("doc_id", "w"))).alias("postings"))
        _written(blocks.drop("file"), f"{path}/blocks")
        # the size's row carries the type of the ids, so that an index without a posting has its schema too
        size = spark.range(1).select(F.lit(n).alias("documents"), F.lit(None).cast(postings.schema["doc_id"].dataType).alias("doc_id"))
    size.coalesce(1).write.parquet(f"{path}/size")
    _written(_blocks(spark, path).groupBy("bucket", "term").agg(F.sum("n").alias("df")).repartition("bucket"), f"{path}/terms")
    return open_index(spark, path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    kind = spark.read.parquet(f"{path}/size").schema["doc_id"].dataType.simpleString()
    return spark.read.schema(f"term string, shard long, n long, top double, postings array<struct<doc_id:{kind},w:double>>, bucket int").parquet(f"{path}/blocks")


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    terms = spark.read.schema("term string, df long, bucket int").parquet(f"{path}/terms")
    return LexicalIndex(terms, _blocks(spark, path), spark.read.parquet(f"{path}/size").first()["documents"])


def _asked(index: LexicalIndex, queries: DataFrame, tokens) -> DataFrame:
    """The known terms of each query: query_id, bucket, term, idf."""
    asked = queries.where("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    idf = F.log(1 + (F.lit(index.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(index.terms, ["bucket", "term"]).select("query_id", "bucket", "term", idf.alias("idf"))


def _heads(index: LexicalIndex, queries: DataFrame, tokens) -> DataFrame:
    """Headers of the blocks of each query's terms: query_id, bucket, term, idf, shard, n, top. Postings are not read."""
    return _asked(index, queries, tokens).join(index.blocks.drop("postings"), ["bucket", "term"])


def _scores(index: LexicalIndex, heads: DataFrame) -> DataFrame:
    keys = ["bucket", "term", "shard"]
    found = heads.select("query_id", "idf", *keys).join(index.blocks.select(*keys, "postings"), keys)
    return found.select("query_id", "idf", F.inline("postings")).groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("w")).alias("score"))


def needed_blocks(index: LexicalIndex, queries: DataFrame, k: int, tokens=analyze) -> DataFrame:
    """The headers of all blocks of the queries' terms, with `kept`: false where no document of the block can be in the top k.

    A document scores at most the sum of the greatest weights that the query's terms have in its shard. The shards of the greatest sums
    are scored first; the k-th score among their documents is a lower bound of the k-th of all, and shards with a lesser sum are left out.
    """
    heads = stored(_heads(index, queries, tokens), "lexical-heads")
    sums = stored(heads.groupBy("query_id", "shard").agg(F.sum(F.col("top") * F.col("idf")).alias("most")), "lexical-sums")
    first = top_k(sums, ["query_id"], "most", "shard", FIRST * k).select("query_id", "shard")
    best = top_k(_scores(index, heads.join(first, ["query_id", "shard"])), ["query_id"], "score", "doc_id", k)
    bound = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    rated = sums.join(bound, "query_id", "left").select("query_id", "shard", (F.col("most") >= F.coalesce("bound", F.lit(0.0)) - SLACK).alias("kept"))
    return heads.join(rated, ["query_id", "shard"])


def search_index(index: LexicalIndex, queries: DataFrame, k: int, tokens=analyze) -> DataFrame:
    """Exact BM25 top k of queries (query_id, text): query_id, rank, doc_id, score (6 digits; ties to the smaller id).

    A query without a known term has no rows. A header for each query, term and shard (`needed_blocks`) would outgrow the postings when
    many queries are asked at once: the postings of their terms are read once and meet the queries by blocks.
    """
    asked = stored(_asked(index, queries, tokens), "lexical-asked")
    held = index.blocks.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").select("term", F.inline("postings"))
    scores = block_top_k(asked.select("query_id", "term", F.col("idf").alias("weight")), held.select(F.col("doc_id").alias("id"), "term", F.col("w").alias("weight")), k)
    return top_k(scores, ["query_id"], "score", "id", k).select("query_id", "rank", F.col("id").alias("doc_id"), "score")
