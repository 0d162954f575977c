"""Runs and samples against each other: pairs, deltas, bindings (4.7-4.13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired_deltas(df: DataFrame, pair: list[str], side: str, left, right, value: str) -> DataFrame:
    """right - left of the value for each pair that has both sides (4.8): one aggregate in place of a self-join."""
    sums = df.groupBy(*pair).agg(F.max(F.when(F.col(side) == left, F.col(value))).alias("left_value"), F.max(F.when(F.col(side) == right, F.col(value))).alias("right_value"))
    return sums.where("left_value IS NOT NULL AND right_value IS NOT NULL").withColumn("delta", F.col("right_value") - F.col("left_value"))


def run_attribution(old_ok: Column, new_ok: Column, same_path: Column, same_evidence: Column) -> Column:
    """Why a case changed between two runs (4.13, 12.21)."""
    return F.when(old_ok & new_ok, "stable").when(~old_ok & ~new_ok, "still_failing").when(new_ok, F.when(same_path, "fixed_evidence").otherwise("fixed_path")).otherwise(F.when(same_evidence, "regressed_policy").otherwise("regressed_evidence"))


def last_binding(evidence: DataFrame, candidates: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each evidence row with the last candidate of its key (4.7); unmatched rows stay, with nulls."""
    last = candidates.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("_last")).select(key, F.col(f"_last.{order}").alias(order), *(F.col(f"_last.{c}").alias(c) for c in columns))
    return evidence.join(last, key, "left")
