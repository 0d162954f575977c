"""Ranking metrics, rewards, gates and grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant_counts: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """recall, reciprocal rank and binary nDCG at k (12.1-12.3) of rows (key, rank, hit) against (key, n_relevant).

    Without a relevant item recall is 1 and nDCG 0; a query without rows scores 0.
    """
    top = ranked.where((F.col("rank") <= k) & F.col("hit"))
    sums = top.groupBy(key).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(k)), F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return relevant_counts.join(sums, key, "left").select(
        key,
        F.round(F.when(F.col("n_relevant") == 0, 1.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n_relevant")), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(F.col("n_relevant") == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal), 6).alias("ndcg"),
    )


def format_score(no_terminal: Column, format_error: Column, empty_path: Column) -> Column:
    return _clamp(1 - 0.35 * no_terminal.cast("int") - 0.65 * format_error.cast("int") - 0.20 * empty_path.cast("int"))


def retrieval_score(recall: Column, mrr: Column, ndcg: Column, identifiers: Column, corpus_mismatch: Column) -> Column:
    score = 0.40 * recall + 0.25 * mrr + 0.25 * ndcg + 0.10 * identifiers
    return _clamp(F.when(corpus_mismatch, F.least(score, F.lit(0.40))).otherwise(score))


def citation_score(is_answer: Column, hit_rate: Column, invalid: Column, cited: Column) -> Column:
    return _clamp(F.when(is_answer, F.when(invalid > 0, F.least(hit_rate, F.lit(0.60))).otherwise(hit_rate)).otherwise(F.when(cited == 0, 1.0).otherwise(0.40)))


def behaviour_score(terminal: Column, path: Column, no_forbidden: Column, web: Column) -> Column:
    return _clamp(0.60 * terminal.cast("int") + 0.20 * path.cast("int") + 0.10 * no_forbidden.cast("int") + 0.10 * web.cast("int"))


def cost_score(extra_steps: Column, hyde_extra: Column, web_extra: Column) -> Column:
    return _clamp(1 - F.least(F.lit(0.40), 0.08 * extra_steps) - 0.20 * hyde_extra.cast("int") - 0.30 * web_extra.cast("int"))


#: Weights of the reward's six parts.
WEIGHTS = {"format": 0.15, "retrieval": 0.12, "citation": 0.08, "answer": 0.15, "behaviour": 0.35, "cost": 0.15}


def total_reward(parts: dict[str, Column], format_error: Column, failed: Column) -> Column:
    """Weighted mean of the six parts, at most .20 after a format error and .30 after a failure (12.15)."""
    total = sum((parts[name] * weight for name, weight in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    return _clamp(F.when(format_error, F.least(total, F.lit(0.20))).when(failed, F.least(total, F.lit(0.30))).otherwise(total))


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def dense_grid(df: DataFrame, rows: str, columns: dict[str, list]) -> DataFrame:
    """Counts of every (row value, column value) pair, 0 where there is none (5.5); column values are stated."""
    ((name, values),) = columns.items()
    grid = df.select(rows).distinct().withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return grid.join(df.groupBy(rows, name).agg(F.count("*").alias("n")), [rows, name], "left").fillna(0, ["n"])


def confusion_matrix(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Counts of expected against actual values, null as 'none' (5.10)."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in (expected, actual)]
    return df.select(*named).groupBy(expected, actual).agg(F.count("*").alias("n"))


def share_over(df: DataFrame, group: str, dimension: str, most: float) -> DataFrame:
    """Values of the dimension that hold more than `most` of their group's rows (5.23)."""
    counts = df.groupBy(group, dimension).agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    return counts.join(totals, group).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).where(F.col("n") > most * F.col("total"))


#: Thresholds of the route gate.
GATES = (("format_rate", ">=", 1.0), ("failures", "<=", 0.0), ("forbidden", "<=", 0.0), ("macro_accuracy", ">=", 0.80), ("min_bucket_accuracy", ">=", 0.60), ("false_releases", "<=", 0.0))


def gate_checks(report: DataFrame) -> DataFrame:
    """One row per gate with its value and verdict (12.18); a missing value fails."""
    rows = [F.struct(F.lit(n).alias("gate"), F.col(n).cast("double").alias("value"), F.lit(t).alias("threshold"), F.coalesce(F.col(n) >= t if op == ">=" else F.col(n) <= t, F.lit(False)).alias("passed")) for n, op, t in GATES]
    return report.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def rule_policy() -> Column:
    """The planner's rule ladder, first match wins (12.25), as 'action/reason'.

    Columns: safety, step, max_steps, history_valid, ended, subject (confirmed, ambiguous, none, not_found), subject_known, realtime,
    local_done, hyde_done, web_done, web_allowed, last (local, hyde, web or null), identifier, evidence_ambiguous, failed, sufficient,
    candidates.
    """
    c = F.col
    web_open = c("web_allowed") & ~c("web_done")
    unsafe = F.lit("refuse/safe_guard_triggered")
    low = F.when(c("candidates") > 0, "local_low_score").otherwise("local_empty")
    return (
        F.when(c("safety") | (c("step") >= c("max_steps")) | ~c("history_valid") | c("ended"), unsafe)
        .when(c("subject") == "ambiguous", "ask/subject_ambiguous")
        .when(c("subject") == "none", "ask/subject_required")
        .when((c("subject") == "confirmed") & ~c("subject_known"), unsafe)
        .when((c("subject") == "not_found") & ~c("realtime"), "refuse/subject_not_found")
        .when(c("realtime") & ~c("web_done"), F.when(c("web_allowed"), "web/realtime_query").otherwise(unsafe))
        .when(~c("local_done") & ~(c("realtime") & c("web_done")), F.when(c("subject") == "confirmed", "local/initial_local_search").otherwise(unsafe))
        .when(c("last").isNull(), "refuse/action_execution_error")
        .when(c("identifier") == "suggestion_required", "ask/identifier_confirmation_required")
        .when(c("identifier") == "not_found", "ask/identifier_not_found")
        .when(c("evidence_ambiguous"), "ask/evidence_ambiguous")
        .when(c("failed") & (c("last") == "web"), "refuse/web_empty_or_failed")
        .when(c("failed"), F.when(web_open, "web/action_execution_error").otherwise("refuse/action_execution_error"))
        .when(c("sufficient"), F.when(c("last") == "web", "answer/web_evidence_available").otherwise(F.concat(F.lit("answer/"), c("last"), F.lit("_evidence_sufficient"))))
        .when((c("last") == "local") & (c("candidates") > 0) & ~c("hyde_done"), "hyde/local_low_score")
        .when(c("last") == "local", F.concat(F.when(web_open, "web/").otherwise("refuse/"), low))
        .when(c("last") == "hyde", F.concat(F.when(web_open, "web/").otherwise("refuse/"), F.lit("hyde_still_insufficient")))
        .otherwise("refuse/web_empty_or_failed")
    )
