"""Visibility, roles, disabled rows and last-event overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(visibility: str, tenant: str, owner: str, *, tenant_id, user_id) -> Column:
    """public, or shared within the tenant, or one's own (3.1, 3.7); null values are not visible."""
    v = F.col(visibility)
    return F.coalesce((v == "public") | ((v == "shared") & (F.col(tenant) == tenant_id)) | (F.col(owner) == user_id), F.lit(False))


def accessible(df: DataFrame, datasets: list, *, tenant_id, user_id, dataset="dataset_id", enabled="enabled", visibility="visibility", tenant="tenant_id", owner="owner_user_id") -> DataFrame:
    """Rows of the datasets that are enabled and visible; no dataset is an error."""
    if not datasets:
        raise ValueError("at least one dataset is needed")
    return df.where(F.col(dataset).isin(datasets) & F.col(enabled) & visible(visibility, tenant, owner, tenant_id=tenant_id, user_id=user_id))


def role(owner: str, member_role: str, visibility: str, user_id) -> Column:
    """owner -> admin, a member's own role, public -> viewer (14.8); else null."""
    return F.when(F.col(owner) == user_id, "admin").when(F.col(member_role).isNotNull(), F.col(member_role)).when(F.col(visibility) == "public", "viewer")


def without(df: DataFrame, disabled: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with no key among the disabled ones (3.5, 4.5)."""
    return df.join(disabled.select(*keys).distinct(), keys, "left_anti")


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by `order` (6.3): one aggregate with map-side combine, no sort of a key's rows."""
    best = F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in columns))


def effective_enabled(base: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """base and not manually disabled (13.7): an override can't enable what its base has disabled; versions are part of the key."""
    status = overrides.select(*keys, "manual_status")
    return base.join(status, keys, "left").withColumn("effective_enabled", F.coalesce("enabled", F.lit(False)) & ~F.coalesce(F.col("manual_status") == "disabled", F.lit(False)))


def reconciled(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """In-flight tasks by the state of the document that still names them as its latest task (4.17, 13.9)."""
    joined = tasks.where(F.col("status").isin("pending", "running")).join(documents.select("latest_task_id", "document_status"), F.col("task_id") == F.col("latest_task_id"), "left")
    return joined.withColumn("new_status", F.when(F.col("document_status") == "completed", "completed").otherwise("failed")).drop("latest_task_id")
