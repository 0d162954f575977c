"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import scratch, written


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, label) for every node of an edge: label is the smallest node of its component.

    Each step is a group-by and a join on the node, so a node with very many links is split like any skewed join key; the steps number
    about the logarithm of the longest path. Every step is written to the shared folder; only two numbers come to the driver.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    with scratch(spark):
        pairs = written(pairs.distinct(), name)
        while True:
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            # large star: every larger neighbour of u goes to the smallest node that u knows
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            # small star: u and its smaller neighbours go to the smallest of these
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            pairs = written(small, name)
            # done when every node has one link and no label has one: then all point at their label
            ends = pairs.select("u", F.lit(0).alias("inner")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(1).alias("inner")).distinct()).groupBy("u").agg(F.count_if(F.col("inner") == 0).alias("links"), F.max("inner").alias("inner"))
            if not ends.where("links > 1 OR (links = 1 AND inner = 1)").limit(1).count():
                break
        out = pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        return written(out, name, up=1)
