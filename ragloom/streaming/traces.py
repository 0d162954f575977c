"""Retrieval traces from a stream of events: created once, steps appended or replaced, whatever is replayed or late (1.8, 1.16, 13.11).

The state is a table of slots: one row for a trace's creation, one for its end and one for each step. Events are merged by a maximum over
(how final, sequence number), which does not depend on their order and takes a repeated event as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of events. A creation never overwrites an earlier one; an append gives way to a completion of its step.
CREATE, APPEND, COMPLETE, FINISH = "create", "append", "complete", "finish"
BUCKETS = 64
_SLOT = "trace_id string, slot string, step int, final int, seq long, payload string"


def slots(events: DataFrame) -> DataFrame:
    """trace_id, slot, step, final, seq, payload of events (trace_id, kind, step, seq, payload); other kinds and null ids are left out."""
    kind = F.col("kind")
    slot = F.when(kind == CREATE, "a_create").when(kind.isin(APPEND, COMPLETE), "b_step").when(kind == FINISH, "c_finish")
    step = F.when(kind.isin(APPEND, COMPLETE), F.col("step").cast("int")).otherwise(-1)
    # the first creation and the first append count, of completions and ends the last
    final = F.when(kind.isin(COMPLETE, FINISH), 1).otherwise(0)
    seq = F.when(final == 1, F.col("seq")).otherwise(-F.col("seq")).cast("long")
    rows = events.select(F.col("trace_id").cast("string").alias("trace_id"), slot.alias("slot"), step.alias("step"), final.cast("int").alias("final"), seq.alias("seq"), F.col("payload").cast("string").alias("payload"))
    return rows.where("trace_id IS NOT NULL AND slot IS NOT NULL AND step IS NOT NULL AND seq IS NOT NULL")


def merged(*states: DataFrame) -> DataFrame:
    """One row for each (trace_id, slot, step): an aggregate with map-side combine, in any order and grouping the same."""
    both = states[0]
    for more in states[1:]:
        both = both.unionByName(more)
    best = F.max(F.struct("final", "seq", "payload"))
    return both.groupBy("trace_id", "slot", "step").agg(best.alias("b")).select("trace_id", "slot", "step", "b.*")


def traces(state: DataFrame) -> DataFrame:
    """trace_id, created, steps (array of step, done, payload by step), finished; traces that were never created are left out, as an update finds none."""
    step = F.when(F.col("slot") == "b_step", F.struct("step", (F.col("final") == 1).alias("done"), "payload"))
    one = lambda slot: F.max(F.when(F.col("slot") == slot, F.struct("payload")))
    found = state.groupBy("trace_id").agg(one("a_create").alias("c"), F.sort_array(F.collect_list(step)).alias("steps"), one("c_finish").alias("f"))
    return found.where("c IS NOT NULL").select("trace_id", F.col("c.payload").alias("created"), "steps", F.col("f.payload").alias("finished"))


def read_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The state as of the batches before `before` (default: all); None if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(f"{_SLOT}, bucket int, batch long").parquet(folder)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    newest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))  # BUCKETS rows
    return rows.join(F.broadcast(newest), ["bucket", "batch"]).select("trace_id", "slot", "step", "final", "seq", "payload", "bucket")


def trace_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: merges a batch of events into the state below `folder`.

    The state is dealt into buckets by trace; a batch rewrites only those it touches, as a version of its own number read from the versions
    before it. A batch that is run again overwrites its own version with the same rows.
    """

    def upsert(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        new = slots(events).withColumn("bucket", F.pmod(F.xxhash64("trace_id"), F.lit(BUCKETS)).cast("int"))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        old = read_state(spark, folder, batch_id)
        both = new if old is None else new.unionByName(old.where(F.col("bucket").isin(touched)))
        best = F.max(F.struct("final", "seq", "payload"))
        state = both.groupBy("bucket", "trace_id", "slot", "step").agg(best.alias("b")).select("trace_id", "slot", "step", "b.*", "bucket", F.lit(batch_id).cast("long").alias("batch"))
        state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(folder)

    return upsert
