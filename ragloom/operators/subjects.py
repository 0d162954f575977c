"""Which known subjects a session's mentions stand for: alias hits, and what they confirm (7.7, 11.15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.text import empty_to_null, normalise_words
from ragloom.operators.predicates import CANDIDATE, score_band
from ragloom.operators.similarity import gram_sets, overlap_pairs
from ragloom.plans.storage import stored

#: Hits that are asked for each mention, and candidates that a mention may put forward.
HITS, OPTIONS = 5, 2


def alias_hits(mentions: DataFrame, aliases: DataFrame, most: int = HITS) -> DataFrame:
    """mention, rank, score, subject_id, standard_name: each distinct mention's best aliases above the candidate threshold.

    mentions: mention. aliases: alias, subject_id, standard_name; repeated rows count once. The score is the Jaccard similarity of the
    trigrams of both in normal form, so the hits come from an overlap join of distinct texts and none is missed. Ties go by subject_id,
    standard_name and alias, nulls first. Mentions are trimmed. An alias of many subjects is cut to `most` of them before it meets the mentions, as all of them
    have one score. Null texts have no hits.
    """
    said = mentions.select(empty_to_null("mention").alias("mention")).where("mention IS NOT NULL").distinct()
    said = gram_sets(said, "mention", normalise_words("mention"), 3)
    known = aliases.select("alias", "subject_id", "standard_name").where("alias IS NOT NULL").distinct()
    place = F.row_number().over(Window.partitionBy("alias").orderBy("subject_id", "standard_name"))
    known = known.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
    percent = round(100 * CANDIDATE)
    met = overlap_pairs(said, gram_sets(known.select("alias").distinct(), "alias", normalise_words("alias"), 3), percent, 100)
    met = met.withColumn("score", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).where(F.col("score") > CANDIDATE)
    hits = met.select(F.col("a").alias("mention"), F.col("b").alias("alias"), "score").join(known, "alias")
    rank = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "subject_id", "standard_name", "alias"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most).select("mention", "rank", "score", "subject_id", "standard_name")


def confirm_subjects(sessions: DataFrame, mentions: DataFrame, hits: DataFrame) -> DataFrame:
    """session_id, status, at, slot, subject_id, standard_name: how each session's mentions are resolved.

    sessions: session_id, one row each. mentions: session_id, at (order), mention. hits: as alias_hits gives them.
    A mention with a hit above the confirm threshold stands for the first such hit; any other puts forward the names of its first OPTIONS
    hits of the candidate band. Confirmed subjects count once by id, candidates once by name, both at their first place; records without
    id or name count for nothing, though they take their mention's turn. The status is `confirmed` with a confirmed subject, else
    `ambiguous` with a candidate, else `not_found`, and `no_mention` where nothing was mentioned (a blank or null mention is none).
    A session has a row for each confirmed subject, or for each candidate (subject_id is null), in order of (at, slot); or one row with
    nulls. Null session ids take no part. All steps are aggregates with map-side combine or joins with one row a mention, so neither a mention nor a session that a third
    of all rows share is gathered.
    """
    said = mentions.withColumn("mention", empty_to_null("mention")).where("mention IS NOT NULL AND session_id IS NOT NULL")
    band = score_band(F.col("score"))
    hit = F.struct("rank", "subject_id", "standard_name")
    # one row a mention: its first confirmed hit, and the first two of the candidate band
    verdict = hits.groupBy("mention").agg(
        F.min(F.when(band == "confirmed", hit)).alias("sure"),
        F.slice(F.array_sort(F.array_agg(F.when(band == "candidate", hit))), 1, OPTIONS).alias("options"),
    )
    verdict = verdict.select("mention", "sure", F.when(F.col("sure").isNull(), F.col("options")).alias("options"))
    # read by four aggregates: stored, so that the hits are made once
    met = stored(said.join(verdict, "mention").select("session_id", "at", "sure", "options"), "subject-verdicts")
    sure = met.where(empty_to_null(F.col("sure.subject_id").cast("string")).isNotNull() & (F.coalesce("sure.standard_name", F.lit("")) != ""))
    sure = sure.groupBy("session_id", F.col("sure.subject_id").alias("subject_id")).agg(F.min(F.struct("at", F.lit(0).alias("slot"), F.col("sure.standard_name").alias("standard_name"))).alias("p"))
    maybe = met.select("session_id", "at", F.posexplode("options").alias("slot", "o")).where("coalesce(o.standard_name, '') <> ''")
    maybe = maybe.groupBy("session_id", F.col("o.standard_name").alias("standard_name")).agg(F.min(F.struct("at", "slot")).alias("p"))
    found = sure.select("session_id", F.lit("confirmed").alias("status"), "p.at", "p.slot", "subject_id", "p.standard_name")
    found = found.unionByName(maybe.select("session_id", F.lit("ambiguous").alias("status"), "p.at", "p.slot", F.lit(None).cast(hits.schema["subject_id"].dataType).alias("subject_id"), "standard_name"))
    # the greatest: confirmed over ambiguous over not_found
    kinds = said.select("session_id", F.lit(0).alias("kind")).unionByName(found.select("session_id", F.when(F.col("status") == "confirmed", 2).otherwise(1).alias("kind")))
    kinds = kinds.groupBy("session_id").agg(F.max("kind").alias("kind"))
    status = F.when(F.col("kind") == 2, "confirmed").when(F.col("kind") == 1, "ambiguous").when(F.col("kind") == 0, "not_found").otherwise("no_mention")
    states = sessions.select("session_id").where("session_id IS NOT NULL").distinct().join(kinds, "session_id", "left").select("session_id", status.alias("status"))
    return states.join(found, ["session_id", "status"], "left").select("session_id", "status", "at", "slot", "subject_id", "standard_name")
