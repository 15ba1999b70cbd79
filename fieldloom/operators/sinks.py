"""Sinks that are read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free hash, a sum, in which rows that are there twice count twice."""
    n, h = df.select(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    return n, int(h or 0)


def verified_write(df: DataFrame, path: str) -> bool:
    """Writes a snapshot over what is there, reads it back, and tells whether it holds the same rows."""
    df.write.mode("overwrite").parquet(path)
    return fingerprint(df) == fingerprint(df.sparkSession.read.parquet(path))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def snapshot(spark: SparkSession, source: str, target: str) -> None:
    """A copy of a folder in place of the target, in any store that Spark reaches; a missing source is an error and
    leaves the target alone. The copy is made beside the target and then takes its name."""
    conf, fs = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    old, new, beside = (fs.Path(p) for p in (source, target, f"{target}.{uuid.uuid4().hex}"))
    here, there = old.getFileSystem(conf), new.getFileSystem(conf)
    if not here.exists(old):
        raise FileNotFoundError(source)
    if not fs.FileUtil.copy(here, old, there, beside, False, conf):
        raise OSError(f"{source} was not copied")
    there.delete(new, True)
    if not there.rename(beside, new):
        raise OSError(f"{target} was not replaced")


def response(df: DataFrame, text: str = "transcription") -> DataFrame:
    """The JSON body of each row's answer: an object with the text."""
    return df.select(F.to_json(F.struct(F.col(text).alias("transcription")), {"ignoreNullFields": "false"}).alias("body"))


def read_value(editable: Column, text: Column, value: Column) -> Column:
    return F.coalesce(F.when(editable, text).otherwise(value), F.lit(""))


def report(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)
