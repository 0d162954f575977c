"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and the code points 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
#: Bits of the filter of keys.
KEY_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="ragloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders of the scratch blocks that are open, innermost last.
_OPEN: ContextVar[tuple[str, ...]] = ContextVar("_OPEN", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go away at the end, but for those written one level up; so do the shuffle files of steps that nothing refers to."""
    folder = f"{shared_folder(spark)}/ragloom/scratch-{uuid.uuid4().hex}"
    token = _OPEN.set((*_OPEN.get(), folder))
    try:
        yield
    finally:
        _OPEN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        free(spark)


def written(df: DataFrame, name: str, up: int = 0, **options: str) -> DataFrame:
    """Cut the lineage: write `df` as a table in the shared folder and read it back. It lasts as long as the scratch block, `up` levels out.
    options are the writer's.

    A lost executor costs only a new read, never a new run of what came before.
    """
    spark, blocks = df.sparkSession, _OPEN.get()
    folder = blocks[-1 - up] if up < len(blocks) else f"{shared_folder(spark)}/ragloom"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Have the driver drop the shuffle files of steps that nothing refers to, instead of whenever it next collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value), with `value` evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def safe_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_mark(id_col: str, text_col: str) -> Column:
    """64-bit identity of a row by id and text; rows that share it can stand for one another."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), safe_text(text_col))


def one_of_each(rows: DataFrame, twins: DataFrame, key: str) -> DataFrame:
    """`rows` with a single row for each key in `twins`."""
    if twins.isEmpty():
        return rows
    return rows.join(twins, key, "left_anti").unionByName(rows.join(twins, key, "left_semi").dropDuplicates([key]))


def asked(rows: DataFrame, asking: DataFrame, key: str) -> DataFrame:
    """`rows` without most of those whose key is not in `asking`, none of the others lost: what is left is joined without a shuffle of all rows.

    KEY_BITS bits of the keys' hashes go to all tasks, a fixed number.
    """
    bit = F.xxhash64(key).bitwiseAND(F.lit(KEY_BITS - 1))
    word, mask = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    bits = asking.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    return rows.withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(mask) != 0).select(*rows.columns)


def parallelism(spark: SparkSession) -> int:
    """How many partitions a shuffle gets: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
