"""Versions, overrides, progress and curation steps (5.14-5.17, 5.20, 6.4, 6.7, 13.x, 15.x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(df: DataFrame, key: str, available: str, metrics: list[str]) -> DataFrame:
    """Sums, and whether every part was available; sums are 0 otherwise (5.14)."""
    whole = F.bool_and(available)
    return df.groupBy(key).agg(whole.alias("available"), *(F.when(whole, F.sum(m)).otherwise(F.lit(0)).alias(m) for m in metrics))


def peak(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """The greatest value of each metric over the chunks of a stream (5.15)."""
    return df.groupBy(key).agg(*(F.max(m).alias(m) for m in metrics))


def unbroken(df: DataFrame, key: str, turn: str) -> DataFrame:
    """Whether the turns of a key are 1..n, each once (5.17)."""
    return df.groupBy(key).agg(F.count("*").alias("turns"), ((F.min(turn) == 1) & (F.max(turn) == F.count("*")) & (F.count_distinct(turn) == F.count("*"))).alias("unbroken"))


def versions(df: DataFrame, key: str, version: str) -> DataFrame:
    """All versions of a key, sorted, and the greatest (5.20)."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(version)).alias("versions"), F.max(version).alias("latest"))


def folded(df: DataFrame, group: str, order: list[str], identity: str, good: Column) -> DataFrame:
    """Every row with the newest good row of its group (6.4), from an aggregate joined back."""
    newest = df.where(good).groupBy(group).agg(F.max(F.struct(*order, F.col(identity).alias("_id"))).alias("_n")).select(group, F.col("_n._id").alias("newest_good"))
    return df.join(newest, group, "left")


def previous(value: str, key: str, order: str) -> Column:
    """The last value before this row that is not null (6.7)."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def adjacent(units: Column, sizes: tuple[int, ...], least: int, most: int) -> Column:
    """Joined runs of neighbouring units of the given sizes with a length in bounds (6.13, 9.16)."""

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(units) - n + 1), lambda i: F.array_join(F.slice(units, i, n), " "))
        return F.when(F.size(units) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.filter(F.concat(*map(runs, sizes)), lambda t: F.length(t).between(least, most))


def round_robin(position: Column, offset: int, pool: list) -> Column:
    """pool[(position + offset) mod n] (6.15)."""
    return F.element_at(F.array(*map(F.lit, pool)), (F.pmod(position + offset, F.lit(len(pool))) + 1).cast("int"))


def transition(state: Column, event: Column) -> Column:
    """State of a task after an event (13.4, 13.5); finished tasks stay as they are."""
    return F.when(state.isin("completed", "failed"), state).when(event == "error", "failed").when(event == "purchase", "completed").otherwise("running")


def progress(df: DataFrame, key: str, order: list[str], event: str) -> DataFrame:
    """The state that a key's events lead to, its first failure's place and the steps done (13.4, 13.5, 13.11): one aggregate, as the
    first final event decides."""
    at = F.struct(*order)
    final = F.col(event).isin("error", "purchase")
    out = df.groupBy(key).agg(F.min(F.when(final, F.struct(at.alias("at"), F.col(event).alias("event")))).alias("_f"), F.count("*").alias("steps"))
    return out.select(key, F.when(F.col("_f").isNull(), "running").otherwise(transition(F.lit("running"), F.col("_f.event"))).alias("state"), "steps")


def rebuilt(base: DataFrame, key: str, version: str, requests: DataFrame) -> DataFrame:
    """Version + 1 and state reset for requested keys whose expected version is current; others report a conflict (13.6, 13.8)."""
    joined = base.join(requests.select(key, "expected_version"), key, "left")
    fits = F.col("expected_version") == F.col(version)
    outcome = F.when(F.col("expected_version").isNull(), "untouched").when(fits, "rebuilt").otherwise("conflict")
    return joined.select(key, (F.col(version) + F.when(fits, 1).otherwise(0)).alias("new_version"), outcome.alias("outcome"))


def drift(live: DataFrame, frozen: DataFrame, key: str, text: str, phrases: list[str]) -> DataFrame:
    """Frozen rows against live ones (15.9, 15.10): key, reasons; frozen has key and content_sha256."""
    own = live.groupBy(key).agg(F.count("*").alias("_n"), F.max(text).alias("_t"))
    joined = frozen.join(own, key, "left")
    lacking = F.filter(F.array(*map(F.lit, phrases)), lambda p: ~F.contains(F.coalesce("_t", F.lit("")), p))
    rules = [(F.col("_n").isNull(), "missing"), (F.col("_n") > 1, "ambiguous"), (F.col("_n").isNotNull() & (F.sha2(F.coalesce("_t", F.lit("")), 256) != F.col("content_sha256")), "changed"), (F.col("_n").isNotNull() & (F.size(lacking) > 0), "phrase_missing")]
    return joined.select(key, F.array_join(F.array_compact(F.array(*(F.when(r, F.lit(c)) for r, c in rules))), ",").alias("reasons"))


def backfill_plan(live: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """What a backfill would write (15.15): key, old_value, new_value, action (write or refuse where another value is set)."""
    joined = wanted.select(key, F.col(value).alias("new_value")).join(live.select(key, F.col(value).alias("old_value")), key)
    action = F.when(F.col("old_value").isNull(), "write").when(F.col("old_value") != F.col("new_value"), "refuse")
    return joined.withColumn("action", action).where("action IS NOT NULL")


def minimums(df: DataFrame, bucket: str, group: str, least_rows: int, least_groups: int) -> DataFrame:
    """Rows and distinct groups of each bucket, and whether both reach their minimum (15.13)."""
    return df.groupBy(bucket).agg(F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups")).withColumn("enough", (F.col("n_rows") >= least_rows) & (F.col("n_groups") >= least_groups))
