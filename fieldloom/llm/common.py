"""What the operators of this subpackage share: checkpoints, checked broadcasts, global positions, bit filters."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of a text: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a side of a join may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
#: The C library's malloc_trim, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, where losing an executor does not lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Hands the memory that this process has freed back to the system, at the end of a worker's task: the worker
    outlives it, and waits beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class Scratch:
    """Parquet tables in the shared folder for the steps inside one operator; they go when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than `rows` rows, else df as it is. Pass narrow rows that are
    cheap to recount (a checkpoint, a small aggregate)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(df: DataFrame, order: list[str], name: str = "_pos") -> DataFrame:
    """df with each row's place, from 0 without gaps, in the order of the named columns.

    Rows are dealt by range, so no key keeps rows together that the later columns tell apart. The rows are kept in a
    checkpoint with their place in their partition; each partition's start is the sum of the counts before it, one row
    a partition, which bounds what is broadcast."""
    within = (
        df.repartitionByRange(partitions(df.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    fixed = cut(within).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return fixed.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_at", "_start")


def bit_filter(df: DataFrame, column: str, log_bits: int) -> np.ndarray:
    """A bit for each value's slot, as 64-bit words. What comes to the driver is 2^log_bits bits at most, however many
    values there are; values that share a slot only let others pass, which later joins remove."""
    slot = F.col(column).bitwiseAND(F.lit((1 << log_bits) - 1))
    word = F.shiftright(slot, 6).cast("int").alias("w")
    bit = F.expr("shiftleft(1L, cast(s & 63 as int))")
    rows = df.select(slot.alias("s"), word).groupBy("w").agg(F.bit_or(bit).alias("b")).toArrow()
    words = np.zeros(1 << max(0, log_bits - 6), np.int64)
    words[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return words.view(np.uint64)


def passes(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values have their bit set in the words of bit_filter()."""
    slot = values.astype(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def log_size(rows: int, least: int, most: int) -> int:
    """The exponent of the power of two next above `rows`, held between two bounds."""
    return min(most, max(least, int(rows).bit_length()))
