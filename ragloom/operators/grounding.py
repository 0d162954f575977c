"""Claims held against the evidence that they name: verbatim spans, entities, strength of the wording (12.23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.plans.storage import stored

#: Words of a run that a span is looked up by, and distinct runs of all spans up to which they are broadcast.
RUN, BROADCAST_RUNS = 3, 1_000_000
#: What counts as an entity or a number, words that bind and words that only permit.
ENTITY = r"(?iU)\b(?:[A-Z]{2,}[A-Z0-9_.-]*|\d+(?:\.\d+)*(?:-[A-Z0-9.]+)?)\b"
BINDING = ("必须", "不得", "禁止", "要求", "must", "shall", "required", "prohibited")
PERMISSIVE = (" may ", " can ", "可以", "可能")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def inner_words(span: Column) -> Column:
    """The words of a span that are whole wherever it occurs: those that touch neither of its ends."""
    inside = F.regexp_replace(F.regexp_replace(span, r"^[\p{L}\p{N}]+", ""), r"[\p{L}\p{N}]+$", "")
    return _words(inside)


def runs(words: Column, size: int) -> Column:
    """Hashes of all runs of `size` words."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(F.lit(size), F.array_join(F.slice(words, i + 1, size), "\u0001")))).otherwise(F.array().cast("array<long>"))


def locate_spans(spans: DataFrame, evidence: DataFrame) -> DataFrame:
    """(span_id, id, at) of every evidence text that holds the span verbatim; at: place of the first occurrence, from 0.

    spans: span_id, span. evidence: id, text. Each span names the rarest of its runs of RUN inner words (single words where it has fewer);
    evidence texts are cut into runs once, only those that some span names are kept, and an equi-join gives the texts to look into. Spans
    without an inner word are too short to be looked up and find nothing here; `grounded` finds them in the evidence that they name.
    """
    words = inner_words(F.col("span"))
    named = F.when(F.size(words) >= RUN, runs(words, RUN)).otherwise(runs(words, 1))
    wanted = stored(spans.select("span_id", "span", F.explode(F.array_distinct(named)).alias("run")), "runs")
    keys = wanted.select("run").distinct()
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_RUNS else keys
    own = F.col("words")
    held = evidence.select("id", _words(F.coalesce("text", F.lit(""))).alias("words")).select("id", F.explode(F.array_distinct(F.concat(runs(own, RUN), runs(own, 1)))).alias("run"))
    held = stored(held.join(keys, "run", "left_semi"), "postings")
    often = held.groupBy("run").agg(F.count("*").alias("n"))
    # a run that no text has rules its span out
    rarest = wanted.join(often, "run", "left").groupBy("span_id", "span").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r"))
    met = rarest.select("span_id", "span", "r.run").join(held, "run").join(evidence.select("id", "text"), "id")
    return met.withColumn("at", F.instr("text", F.col("span")) - 1).where("at >= 0").select("span_id", "id", F.col("at").cast("long").alias("at"))


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(text, F.lit(mark))
    return out


def grounded(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every claim with the checks of its binding, and `passed` (12.23).

    claims: claim_id, evidence_id, claim, span, relation; without a binding span and relation are null. evidence: id, text. A claim
    passes if it is bound, the relation is `entailed`, the span occurs verbatim in the evidence, all entities and numbers of the claim
    occur in the span, and a claim that binds does not rest on a span that only permits.
    """
    known = evidence.select(F.col("id").alias("evidence_id"), F.coalesce("text", F.lit("")).alias("_text"))
    claim, span = F.coalesce("claim", F.lit("")), F.coalesce("span", F.lit(""))
    entities = [F.regexp_extract_all(x, F.lit(ENTITY), F.lit(0)) for x in (claim, span)]
    checks = {
        "bound": F.col("span").isNotNull() | F.col("relation").isNotNull(),
        "entailed": F.coalesce(F.col("relation") == "entailed", F.lit(False)),
        "span_in_fact": (span != "") & (F.coalesce(F.instr("_text", span), F.lit(0)) > 0),
        "entities_consistent": F.size(F.array_except(*entities)) == 0,
        "strength_consistent": ~(_any(F.lower(claim), BINDING) & _any(F.lower(span), PERMISSIVE) & ~_any(F.lower(span), BINDING)),
    }
    rows = claims.join(known, "evidence_id", "left").select(*(F.col(c) for c in claims.columns), *(v.alias(k) for k, v in checks.items()), F.when((span != "") & (F.instr("_text", span) > 0), F.instr("_text", span) - 1).cast("long").alias("at"))
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.col(name)
    return rows.withColumn("passed", passed)


def coverage(checked: DataFrame, key: str = "evidence_id") -> DataFrame:
    """Per evidence: its claims, how many pass, and whether all do."""
    return checked.groupBy(key).agg(F.count("*").alias("claims"), F.count_if("passed").alias("passing"), F.bool_and("passed").alias("covered"))
