"""Strict JSON lines (1.5): every line is held against the schema, and what is wrong carries its file and line number.

Built on Spark's own text reader, so that files are split, and stores that only Spark reaches work too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from ragloom.plans.storage import stored

_BAD = "_bad_line"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1), value of every line of the files.

    A file may be read in several blocks: lines are numbered within their block in the order of reading, and the blocks of a file by the
    counts of those before them, so no file goes through one task. The lines are written once, as the order of reading is not kept otherwise.
    """
    read = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = stored(read, "lines")
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("path", "block", "first", before.alias("before"))
    return lines.join(offsets, ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def checked_jsonl(spark: SparkSession, path: str, schema: StructType, *, required: list[str] | None = None, extra: bool = False) -> DataFrame:
    """path, line, row (struct), problem (null if the line is fine). Blank lines and those that begin with # are left out.

    A line is wrong if it is no JSON object, holds a value of another type than the schema's, lacks a required field or has it null
    (default: all fields that the schema has as not nullable), or, unless `extra`, has fields that the schema does not name.
    """
    needed = required if required is not None else [f.name for f in schema.fields if not f.nullable]
    open_ = StructType([*(StructField(f.name, f.dataType, True) for f in schema.fields), StructField(_BAD, StringType(), True)])
    lines = numbered_lines(spark, path).where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    rows = lines.withColumn("row", F.from_json("value", open_, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    unknown = F.array_except(keys, F.array(*(F.lit(f.name) for f in schema.fields)).cast("array<string>"))
    problem: Column = F.when(F.col("row").isNull() | F.json_object_keys("value").isNull(), F.lit("no JSON object")).when(F.col(f"row.{_BAD}").isNotNull(), F.lit("a value of another type, or no JSON"))
    for name in needed:
        problem = problem.when(F.col(f"row.{name}").isNull(), F.lit(f"no value for {name}"))
    if not extra:
        problem = problem.when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_join(unknown, ", ")))
    return rows.select("path", "line", F.struct(*(F.col(f"row.{f.name}").alias(f.name) for f in schema.fields)).alias("row"), problem.alias("problem"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, **checks) -> DataFrame:
    """The rows of strict JSON lines; the first line that is wrong ends the job with <path>:<line>: <problem>."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = checked_jsonl(spark, path, schema, **checks)
    message = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("problem"))
    # the check is part of the row, so that no projection drops it
    return rows.select(F.when(F.col("problem").isNotNull(), F.raise_error(message).cast(rows.schema["row"].dataType)).otherwise(F.col("row")).alias("row")).select("row.*")
