"""Set tests between arrays of a row and between tables (8.x, 4.14, 4.16, 15.7, 15.13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(wanted: Column, found: Column) -> Column:
    """What is wanted and not found, sorted (8.4)."""
    return F.array_sort(F.array_except(wanted, found))


def covers(wanted: Column, found: Column) -> Column:
    """Whether everything wanted is found (8.5)."""
    return F.size(F.array_except(wanted, found)) == 0


def same_members(a: Column, b: Column) -> Column:
    """Set equality of two arrays (8.6)."""
    return covers(a, b) & covers(b, a)


def forbidden(path: Column, banned: Column) -> Column:
    """The banned members of a path, sorted and distinct (8.8)."""
    return F.array_sort(F.array_intersect(path, banned))


def merged(lists: dict[str, DataFrame], key: str, identity: str, order: str) -> DataFrame:
    """The lists one after the other, each identity of a key once, at its first place (8.1): key, identity, source, place."""
    rows = [df.select(key, identity, F.struct(F.lit(n).alias("list"), F.col(order).cast("long").alias("at"), F.lit(name).alias("source")).alias("_at")) for n, (name, df) in enumerate(lists.items())]
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more)
    return both.groupBy(key, identity).agg(F.min("_at").alias("_at")).select(key, identity, F.col("_at.source").alias("source"), F.col("_at.list").cast("long").alias("list"), F.col("_at.at").alias("place"))


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ or that one side lacks (4.12, 4.16): key, left_value, right_value, status."""
    joined = left.select(F.col(key), F.col(value).alias("left_value")).join(right.select(F.col(key), F.col(value).alias("right_value"), F.lit(True).alias("_right")), key, "full")
    status = F.when(F.col("_right").isNull(), "only_left").when(F.col("left_value").isNull(), "only_right").when(~F.col("left_value").eqNullSafe(F.col("right_value")), "differs")
    return joined.withColumn("status", status).where("status IS NOT NULL").select(key, "left_value", "right_value", "status")


def partition_report(parts: dict[str, DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """How the parts cover the whole (8.7): per status, keys in one part, in several, in none, and in a part but not in the whole."""
    held = None
    for name, df in parts.items():
        one = df.select(key).distinct().withColumn("part", F.lit(name))
        held = one if held is None else held.unionByName(one)
    counted = held.groupBy(key).agg(F.count("*").alias("parts"))
    joined = whole.select(key).distinct().withColumn("_in", F.lit(True)).join(counted, key, "full")
    status = F.when(F.col("_in").isNull(), "outside").when(F.col("parts").isNull(), "uncovered").when(F.col("parts") > 1, "overlap").otherwise("once")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def crossing_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups with rows in more than one split (3.24, 4.14)."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1")
