"""Search that knows identifiers: exact hits, then broad ones, then suggestions, decided per query within one plan (10.7, 11.5, 11.6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators.retrieval import bm25_top_k, deletions, top_k
from ragloom.plans.storage import stored

#: Types whose values may be written with other separators, and how a query ended.
CODED = ("equipment_model", "alarm_code", "sop_code", "part_number")
NOT_APPLICABLE, EXACT, FALLBACK, SUGGESTED, NOT_FOUND = "not_applicable", "exact_match", "fallback_exact_match", "suggestion_required", "not_found"
_MAP = "map<string,array<string>>"


def guaranteed(metadata: Column, requested: Column, structured: list[str]) -> Column:
    """The metadata of a row that the structured filter has let through, with what the projection left out (11.6).

    A field of a single requested value is filled with it where it is empty; of several values nobody knows which one it was.
    """
    single = F.map_filter(requested, lambda kind, values: kind.isin(*structured) & (F.size(values) == 1))
    given = F.map_filter(F.coalesce(metadata, F.create_map().cast(_MAP)), lambda _, values: F.size(F.coalesce(values, F.array())) > 0)
    return F.map_zip_with(given, single, lambda _, own, asked: F.coalesce(own, asked))


def matched_values(requested: Column, identifiers: Column, text: Column) -> Column:
    """Per requested type, the requested values that the record has: among its identifiers, or written out in its text (10.6)."""

    def has(kind: Column, value: Column) -> Column:
        written = F.when(kind.isin(*CODED) & (T.compact_identifier(value) != ""), T.contains_identifier(text, value)).otherwise(F.coalesce(F.contains(text, value), F.lit(False)))
        return F.coalesce(F.array_contains(F.element_at(identifiers, kind), value), F.lit(False)) | written

    return F.transform_values(requested, lambda kind, values: F.filter(values, lambda v: has(kind, v)))


def compatible(hits: DataFrame) -> DataFrame:
    """hits (query_id, requested, record_id, metadata, text) whose record has a requested value of every requested type (10.7).

    Adds `matched`. A model in one record and an alarm in another do not add up; several values of a type may be covered by several records.
    """
    found = hits.withColumn("matched", matched_values(F.col("requested"), T.record_identifiers(F.coalesce("metadata", F.create_map().cast(_MAP)), "text"), F.coalesce("text", F.lit(""))))
    return found.where(F.forall(F.map_values("matched"), lambda values: F.size(values) > 0))


def covered(evidence: DataFrame, requests: DataFrame) -> DataFrame:
    """query_id of the requests all of whose values are matched by their evidence together."""
    wanted = requests.select("query_id", F.explode("requested").alias("kind", "values")).select("query_id", "kind", F.explode("values").alias("value")).distinct()
    have = evidence.select("query_id", F.explode("matched").alias("kind", "values")).select("query_id", "kind", F.explode("values").alias("value")).distinct()
    lacking = wanted.join(have, ["query_id", "kind", "value"], "left_anti").select("query_id")
    return wanted.select("query_id").distinct().join(lacking, "query_id", "left_anti")


def exact_hits(requests: DataFrame, records: DataFrame, structured: list[str], k: int) -> DataFrame:
    """query_id, record_id, rank: the first k records that have one of the values of every structured type asked for.

    An equi-join on (type, value), so records of other values are never met; most matched values first, then the smaller id. Requests for
    the same values are one.
    """
    wanted = F.array_sort(F.transform(F.map_entries(F.map_filter("requested", lambda kind, _: kind.isin(*structured))), lambda e: F.struct(e["key"].alias("kind"), F.array_sort(F.array_distinct(e["value"])).alias("values"))))
    requests = stored(requests.select("query_id", wanted.alias("wanted")), "wanted")
    firsts = stored(requests.groupBy("wanted").agg(F.min("query_id").alias("first")), "distinct")
    types = firsts.select("first", F.size("wanted").alias("types"))
    asked = firsts.select("first", F.inline("wanted")).select("first", "kind", F.explode("values").alias("value"))
    held = records.select("record_id", F.explode("metadata").alias("kind", "values")).where(F.col("kind").isin(*structured)).select("record_id", "kind", F.explode(F.array_distinct("values")).alias("value"))
    found = asked.join(held, ["kind", "value"]).groupBy("first", "record_id").agg(F.count_distinct("kind").alias("kinds"), F.count("*").alias("values"))
    best = top_k(found.join(types, "first").where("kinds = types"), ["first"], "values", "record_id", k).select("first", "record_id", "rank")
    return requests.join(firsts, "wanted").select("query_id", "first").join(best, "first").select("query_id", "record_id", "rank")


def suggestions(requests: DataFrame, records: DataFrame, k: int = 3) -> DataFrame:
    """query_id, suggested (map): per requested type at most k values one edit away, by (distance, -records, value) (7.8).

    Only values of records that have the query's other types exactly count, so that no other device's code is offered.
    """
    owned = stored(records.select("record_id", T.record_identifiers(F.coalesce("metadata", F.create_map().cast(_MAP)), "text").alias("identifiers")), "identifiers")
    values = owned.select("record_id", F.explode("identifiers").alias("kind", "values")).where(F.col("kind").isin(*CODED)).select("record_id", "kind", F.explode("values").alias("value")).distinct()
    keyed = values.select("kind", "value").distinct().select("kind", "value", F.explode(deletions(T.compact_identifier("value"))).alias("key"))
    asked = requests.select("query_id", "requested", F.explode("requested").alias("kind", "asked")).select("query_id", "requested", "kind", "asked", F.explode("asked").alias("own"))
    asked = asked.select("query_id", "requested", "kind", "asked", "own", F.explode(deletions(T.compact_identifier("own"))).alias("key"))
    distance = F.levenshtein(T.compact_identifier("own"), T.compact_identifier("value"))
    near = asked.join(keyed, ["kind", "key"]).where(~F.array_contains("asked", F.col("value")) & T.compatible_format("kind", "own", "value"))
    near = near.withColumn("distance", distance).where("distance <= 1").groupBy("query_id", "kind", "value").agg(F.min("distance").alias("distance"), F.any_value("requested").alias("requested"))
    others = F.forall(F.map_entries("requested"), lambda e: (e["key"] == F.col("kind")) | F.arrays_overlap(F.coalesce(F.element_at(F.col("identifiers"), e["key"]), F.array().cast("array<string>")), e["value"]))
    fit = near.join(values, ["kind", "value"]).join(owned, "record_id").where(others).groupBy("query_id", "kind", "value", "distance").agg(F.count("*").alias("records"))
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("distance", F.desc("records"), "value"))
    best = fit.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))
    return best.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "values")))).alias("suggested"))


def identifier_search(requests: DataFrame, records: DataFrame, tokens, *, structured: list[str], k: int = 5) -> DataFrame:
    """query_id, status, stage, record_ids, matched, suggested, question of every request (11.5).

    requests: query_id, query, requested (map of type to values; null or empty: a plain search). records: record_id, metadata (the same
    kind of map; types in `structured` are indexed), shown (the metadata that a hit brings along, may lack fields) and text; already cut to
    what the caller may read. tokens: text column -> array, of the broad stage's BM25.

    Each stage runs on the queries that the ones before left open: exact hits by the structured values; the broad search over the text with
    the identifiers appended; suggestions. Records are evidence only if `compatible`; a query is done once its evidence covers all values.
    Without that the broad hits are returned, but never as a match. Defined results: ids are unique; null texts are empty; nothing found
    gives an empty array.
    """
    requests = stored(requests.select("query_id", "query", F.coalesce("requested", F.create_map().cast(_MAP)).alias("requested")), "requests")
    coded = requests.where(F.size("requested") > 0)
    with_fields = coded.where(F.exists(F.map_keys("requested"), lambda kind: kind.isin(*structured)))

    def evidence(hits: DataFrame, metadata: Column) -> DataFrame:
        rows = hits.join(requests.select("query_id", "requested"), "query_id").join(records, "record_id")
        return stored(compatible(rows.select("query_id", "requested", "record_id", "rank", metadata.alias("metadata"), "text")).select("query_id", "record_id", "rank", "matched"), "evidence")

    first = evidence(exact_hits(with_fields, records, structured, k), guaranteed(F.col("shown"), F.col("requested"), structured))
    done = stored(covered(first, with_fields), "covered")

    left = stored(requests.join(done, "query_id", "left_anti"), "left")
    broad = stored(bm25_top_k(left.select("query_id", T.append_identifiers("query", "requested").alias("text")), records.select(F.col("record_id").alias("id"), "text"), k, tokens).select("query_id", F.col("doc_id").alias("record_id"), "rank"), "broad")
    second = evidence(broad.join(coded.select("query_id"), "query_id", "left_semi"), F.col("shown"))
    also = stored(covered(second, left.where(F.size("requested") > 0)), "covered")
    rest = left.where(F.size("requested") > 0).join(also, "query_id", "left_anti")
    offered = suggestions(rest, records)

    def listed(hits: DataFrame) -> DataFrame:
        return hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "record_id"))), lambda x: x["record_id"]).alias("record_ids"))

    def joined(found: DataFrame, which: DataFrame) -> DataFrame:
        kinds = found.join(which, "query_id", "left_semi").select("query_id", F.explode("matched").alias("kind", "values")).select("query_id", "kind", F.explode("values").alias("value"))
        kinds = kinds.groupBy("query_id", "kind").agg(F.sort_array(F.collect_set("value")).alias("values"))
        return kinds.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "values")))).alias("matched"))

    parts = [
        (done, 1, F.lit(EXACT), first.join(done, "query_id", "left_semi"), first),
        (also, 2, F.when(F.exists(F.map_keys("requested"), lambda kind: kind.isin(*structured)), FALLBACK).otherwise(EXACT), second.join(also, "query_id", "left_semi"), second),
        (rest.select("query_id"), 3, F.lit(None), broad, None),
        (requests.where(F.size("requested") == 0).select("query_id"), 2, F.lit(NOT_APPLICABLE), broad, None),
    ]
    out = None
    for which, stage, status, hits, found in parts:
        one = requests.join(which, "query_id", "left_semi").join(listed(hits.join(which, "query_id", "left_semi")), "query_id", "left")
        one = one.join(joined(found, which), "query_id", "left") if found is not None else one.withColumn("matched", F.lit(None).cast(_MAP))
        one = one.select("query_id", "requested", status.cast("string").alias("status"), F.lit(stage).alias("stage"), F.coalesce("record_ids", F.array().cast(records.select(F.array("record_id")).schema[0].dataType)).alias("record_ids"), "matched")
        out = one if out is None else out.unionByName(one)
    out = out.join(offered, "query_id", "left")
    status = F.coalesce("status", F.when(F.size(F.coalesce("suggested", F.create_map().cast(_MAP))) > 0, SUGGESTED).otherwise(NOT_FOUND))
    question = F.when(F.col("status") == SUGGESTED, T.suggestion_question("requested", "suggested")).when(F.col("status") == NOT_FOUND, T.not_found_question("requested"))
    return out.withColumn("status", status).select("query_id", "status", "stage", "record_ids", "matched", "suggested", question.alias("question"))
