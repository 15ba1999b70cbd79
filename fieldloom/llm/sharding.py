"""Sharding by a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from fieldloom.llm.common import cut, positions

#: Bits of each dimension.
BITS = 8


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the curve of points given as rows of `axes`, each coordinate below 2**bits.

    Every level of the grid, from the coarsest, takes one bit of each coordinate; the curve inside a cell is the
    parent's curve reflected and with two axes exchanged, which is undone on the lower bits before they are read. The
    bits are then read as a Gray code."""
    x = np.array(axes, np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(len(x)):
            there = (x[d] & bit) != 0
            swap = np.where(there, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(there, low, swap)
            x[d] ^= swap
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(len(x)):
            place = (place << 1) | ((x[d] >> level) & 1)
    return place


@F.pandas_udf(LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert(np.stack([a, b, c], axis=1)) if len(a) else np.zeros(0, np.int64))


def by_name(name: str) -> Column:
    """A name's coordinate: the top bits of its CRC-32, the same in every run; null goes to 0."""
    return F.coalesce(F.shiftright(F.crc32(F.col(name).cast("string").cast("binary")), 32 - BITS), F.lit(0))


def by_size(size: Column) -> Column:
    """A size's coordinate: eight steps to the power of two."""
    return F.least(F.lit((1 << BITS) - 1), F.floor(8 * F.log2(size)).cast("long"))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents in shards 0 to shards - 1 that are runs of one Hilbert curve over source, language and size; the
    shards' row counts are at most one apart.

    A reader that wants some sources, languages or sizes needs few shards, as near cells of the curve share a run. The
    sort has the text's CRC-32 and the doc_id after the curve's place, so equal texts with equal metadata are next to
    each other, and no cell, however many rows it has, stays in one task.

    Returns doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) and curve. A null text counts as
    empty; a null source or language has coordinate 0; repeated rows each get a slot; an empty table gives an empty
    result; other columns are not read."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        by_name("source").alias("_a"),
        by_name("lang").alias("_b"),
    )
    keys = keys.withColumn("_c", by_size(F.col("size")))
    keys = cut(keys.withColumn("curve", _curve("_a", "_b", "_c")).drop("_a", "_b", "_c"))
    n = keys.count()
    placed = positions(keys, ["curve", "text_crc32", "doc_id", "size"])
    at = F.expr(f"cast(_pos * {shards}L div {max(n, 1)}L as int)")
    first = F.expr(f"(cast(shard as long) * {n}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", at).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_pos") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
