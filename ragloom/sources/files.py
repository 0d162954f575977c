"""Sources and sinks: Markdown texts, JSON lines, replayed records, upserts, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files as rows path, title (file stem), text with \\n line ends (1.1, 1.2); other extensions are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,MD}")
    text = F.regexp_replace("value", r"\r\n?", "\n")
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("title"), text.alias("text"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order, nulls kept (1.6)."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def replay(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Logged observations by (snapshot_id, case_id, action, query with white space collapsed) (1.9): `matches` 0 is a miss, over 1 a duplicate."""
    keys = ["snapshot_id", "case_id", "action"]
    query = F.trim(F.regexp_replace("query", r"\s+", " ")).alias("_query")
    found = log.select(*keys, query, "observation").groupBy(*keys, "_query").agg(F.count("*").alias("_n"), F.min("observation").alias("observation"))
    return requests.withColumn("_query", query).join(found, [*keys, "_query"], "left").withColumn("matches", F.coalesce("_n", F.lit(0))).drop("_n", "_query")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete-then-insert by document (1.13): old rows whose keys come anew go, then the new rows follow."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], immutable: list[str]) -> DataFrame:
    """Update or insert (1.15): `immutable` columns keep their old value, all others take the new one."""
    o, n = old.alias("o"), new.alias("n")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    pair = o.withColumn("_old", F.lit(True)).alias("o").join(n.withColumn("_new", F.lit(True)).alias("n"), same, "full_outer")
    pick = [F.when(F.col("o._old") & (F.col("n._new").isNull() | F.lit(c in immutable or c in keys)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns]
    return pair.select(*pick)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file below a folder (15.21)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
