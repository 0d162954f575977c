"""Operator 9, quality rules, line first (DataFrame functions only).

Every line is judged by itself (punctuation, shouting, symbols, navigation, boilerplate); failing lines are removed; a document that
loses too much of its text is rejected. Document-level counts (symbols, repeated lines, repeated 5-word windows) come first and reject
by themselves. All work stays within a row: no shuffle, so long or repeated texts cost only their own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.common import SPACES, let, safe_text, table, words

#: Fixed values of the line rules.
BOILERPLATE = r"(?i)\b(?:licensed under|all rights reserved|copyright|cookie policy|privacy policy|terms of (?:use|service)|click here|subscribe|sign up|log in|enable javascript)\b|©"
NAVIGATION = r"(?i)^\W*(?:home|about|about us|contact|contact us|login|menu|next|previous|prev|share|search|back to top|read more|skip to content)\W*$"
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 5


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def symbols(text: Column) -> Column:
    return F.length(text) - F.length(_without(text, SYMBOLS))


def word_chars(text: Column) -> Column:
    return F.length(_without(text, WHITE))


def repeated_words(w: Column) -> Column:
    """How many words lie in a WINDOW-word window that the text holds twice or more."""

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    def of_sorted(s: Column) -> Column:
        twin = F.filter(s, lambda e, i: F.get(s, i - 1)["h"].eqNullSafe(e["h"]) | F.get(s, i + 1)["h"].eqNullSafe(e["h"]))
        return covered(F.sort_array(F.transform(twin, lambda e: e["p"])))

    def of_hashes(h: Column) -> Column:
        once = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(once, 0).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), of_sorted))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(WINDOW))))
    return F.when(F.size(w) <= WINDOW, 0).otherwise(let(hashes, of_hashes))


def line_fails(line: Column) -> Column:
    """True for a line that has a word and breaks a rule."""
    n = F.length(line)
    shouting = F.length(F.regexp_replace(line, r"!{2,}", "")) + 6 <= n  # three or more "!!"
    unpunctuated = (n >= 400) & ~line.rlike(r"[.!?:;,]")
    return (20 * symbols(line) > n) | shouting | unpunctuated | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20, max_lost_percent: int = 50) -> DataFrame:
    """One row per input row: doc_id, the counts, `base_failed`, `clean_text` (failing lines removed), `lost_chars`, `kept`.

    A document is kept if its base checks hold and the removed lines hold at most max_lost_percent of its word characters. Defined
    results: a null or empty text has no words and is rejected; ids are passed through, null and repeated ones too; an empty table
    gives no rows; other columns are not read.
    """
    judged = _judged(docs, id_col, text_col, min_words, max_repeat_percent, max_lost_percent)
    return judged.drop("row")


def _judged(docs: DataFrame, id_col: str, text_col: str, min_words: int, max_repeat_percent: int, max_lost_percent: int) -> DataFrame:
    """What quality_rules returns, and `row`: all columns of the input row."""
    t = F.col("t")
    src = docs.select(F.col(id_col).alias("doc_id"), safe_text(text_col).alias("t"), F.struct("*").alias("row"))
    lines = F.filter(F.split(t, "\n", -1), lambda line: F.length(F.trim(F.translate(line, WHITE[1:], " " * (len(WHITE) - 1)))) > 0)
    counted = src.select(
        "doc_id", "t", "row",
        let(words(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("rep"))).alias("w"),
        word_chars(t).alias("chars"), symbols(t).alias("sym"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("dup"), F.transform(x, lambda y: F.struct(y.alias("line"), line_fails(y).alias("bad"))).alias("lines"))).alias("l"),
    )
    counted = counted.select(
        "doc_id", "row", F.col("w.n").cast("long").alias("n_words"), F.col("chars").cast("long").alias("word_chars"), F.col("sym").cast("long").alias("n_symbols"),
        F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("w.rep").cast("long").alias("n_repeat_words"),
        F.when(F.exists("l.lines", lambda x: x["bad"]), F.array_join(F.transform(F.filter("l.lines", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")).otherwise(F.col("t")).alias("clean_text"),
        F.aggregate("l.lines", F.lit(0), lambda a, x: a + F.when(x["bad"], word_chars(x["line"])).otherwise(0)).cast("long").alias("lost_chars"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lost = 100 * F.col("lost_chars") > max_lost_percent * F.col("word_chars")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)


def cleaned_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", min_words: int = 10, max_repeat_percent: int = 20, max_lost_percent: int = 50) -> DataFrame:
    """The rows of `docs` that quality_rules keeps, with the failing lines taken out of their text; length_col, if there, follows the text."""
    kept = _judged(docs, id_col, text_col, min_words, max_repeat_percent, max_lost_percent).where("kept")
    new = {text_col: F.col("clean_text"), length_col: F.length("clean_text").cast("long")}
    return kept.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SP = r"[\x20\x09-\x0D]+"
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_SP}'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, p, array_to_string(w[p:p+4], ' ') AS g FROM g),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM h) WHERE n >= 2),
c AS (SELECT doc_id, count(DISTINCT p + k) AS rep FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
l1 AS (SELECT doc_id, line, length(line) AS n, length(regexp_replace(line, '{_SP}', '', 'g')) AS chars, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym FROM l0),
l AS (SELECT doc_id, line, chars,
        (20 * sym > n) OR length(regexp_replace(line, '!{{2,}}', '', 'g')) + 6 <= n OR (n >= 400 AND NOT regexp_matches(line, '[.!?:;,]'))
        OR regexp_matches(line, '{NAVIGATION}') OR regexp_matches(line, '{BOILERPLATE}') AS bad
      FROM l1 WHERE chars > 0),
x AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost FROM l GROUP BY doc_id),
a AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SP}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (100 * lost > 50 * word_chars) AS kept
FROM a
"""
