"""Mixing sources to target weights by fitting each source's budget with whole documents."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD, checked, cut, positions


def targets(sizes: dict[str | None, int], weights: Iterable[float], share: float, cap: float) -> dict[str | None, float]:
    """Each source's target. Sources in the order of code points, null last, take the weights in turn; together they
    get `share` of all sizes; a target stops at `cap` times its source's size, and what is above goes to the others
    by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    turn = list(weights)
    weight = {s: float(turn[i % len(turn)]) for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > cap * sizes[s]]
        if not full:
            return out | {s: weight[s] * unit for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to the budget, or as near as found.

    First every length gives its proportional share, rounded down, then long documents go in until no more than about
    half the window is open, and a few short ones back out; a bounded knapsack over what is left of each length fits that rest. The sums reachable
    after each step are bits of one integer; a length's count enters by powers of two."""
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return np.array(counts, np.int64)
    take = [c * budget // total for c in counts]
    rest = budget - sum(a * b for a, b in zip(lengths, take, strict=True))
    long_first = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in long_first:
        more = min(counts[i] - take[i], max(0, rest - window // 2) // lengths[i])
        take[i] += more
        rest -= more * lengths[i]
    for i in reversed(long_first):  # some short ones go back, which lets the knapsack choose among more sums
        back = min(take[i], 8, max(0, window - rest) // lengths[i])
        take[i] -= back
        rest += back * lengths[i]
    spare = [i for i in reversed(long_first) if counts[i] > take[i]]
    limit = rest + max((lengths[i] for i in spare), default=0)
    within, reach, steps = (1 << (limit + 1)) - 1, 1, []
    for i in spare:
        n, k = min(counts[i] - take[i], limit // lengths[i]), 1
        while n > 0 and not reach >> rest & 1:
            m = min(k, n)
            steps.append((i, m, reach))
            reach |= (reach << (lengths[i] * m)) & within
            n, k = n - m, 2 * k
    off = next(d for d in range(limit + 2) if (d <= rest and reach >> (rest - d) & 1) or reach >> (rest + d) & 1)
    at = rest - off if off <= rest and reach >> (rest - off) & 1 else rest + off
    for i, m, before in reversed(steps):
        if not before >> at & 1:
            take[i] += m
            at -= lengths[i] * m
    return np.array(take, np.int64)


def seeded(seed: int) -> Column:
    """A hash of the seed, the doc_id and the text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.crc32(text))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17,
    window: int = 1 << 16,
) -> DataFrame:
    """How often the mix takes each document, so that each source's words come near its target (see targets()).

    A source's documents are counted by exact length. All are taken as often as the budget allows whole; the rest of
    the budget picks a number of documents of each length (see fit()), and within a length the documents come in the
    order of a seeded hash. What one task sees of a source is one row per distinct length, and what the targets see is
    one row per source. Documents are ranked by a global sort, so a length that a third of the rows share is spread.

    Returns doc_id, size (words), source_size, target, taken (words, repeats counted), times and _key, the hash. A null text has no
    words; documents without words are taken 0 words; equal rows are interchangeable; an empty table gives an empty
    result; other columns are not read. Reruns agree: the hash is of seed, doc_id and the text's CRC-32."""
    base = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            seeded(seed).alias("_key"),
        )
    )
    by_length = base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"))

    def aim(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [None if pd.isna(s) else s for s in pdf["source"]]
        found = targets({s: int(n) for s, n in zip(names, pdf["source_size"], strict=True)}, weights, share, cap)
        return pd.DataFrame({"source": names, "source_size": pdf["source_size"], "target": [found[s] for s in names]})

    aims = totals.groupBy().applyInPandas(aim, "source string, source_size long, target double")
    aims = cut(aims).withColumnRenamed("source", "_source")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        total, budget = int(pdf["source_size"].iloc[0]), int(pdf["target"].iloc[0] + 0.5)
        whole = min(budget // total, int(cap)) if total else 0
        pdf = pdf.assign(whole=whole, some=0)
        some = (pdf["size"] > 0).to_numpy()
        if total and whole < int(cap):
            taken = fit(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], budget - whole * total, window)
            pdf.loc[some, "some"] = taken
        return pdf[["source", "size", "source_size", "target", "whole", "some"]]

    plan = by_length.join(checked(aims), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    plan = plan.groupBy("source").applyInPandas(
        choose, "source string, size long, source_size long, target double, whole long, some long"
    )
    ranked = positions(base, ["source", "size", "_key", "doc_id"])
    firsts = ranked.groupBy("source", "size").agg(F.min("_pos").alias("_first"))
    plan = plan.withColumnsRenamed({"source": "_s", "size": "_z"}).join(
        firsts, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_z") == F.col("size"))
    )
    plan = cut(plan.drop("source", "size"))
    joined = ranked.join(checked(plan), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    times = F.col("whole") + (F.col("_pos") - F.col("_first") < F.col("some")).cast("long")
    times = F.when(F.col("size") > 0, times).otherwise(F.lit(0)).cast("long")
    return joined.withColumn("times", times).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "_key"
    )


def repeated(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """docs, all its columns, whatever their names, each row as often as the mix takes it; rows taken 0 times are left
    out, and so are rows without words, a null text among them. Rows that agree in doc_id and text, repeated or not,
    share what the mix takes of them evenly; a null doc_id or source is a value like any other; ties go by a seeded
    hash; a very long text is one document, taken whole or not at all; an empty table gives an empty result."""
    times = mix(docs, seed=seed, **options).groupBy("_key").agg(F.sum("times").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    times = cut(times.where("_times > 0"))
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), seeded(seed).alias("_own")).join(checked(times), F.col("_own") == F.col("_key"))
    once = rows.where("_rows = 1")
    if times.where("_rows > 1").limit(1).count():
        nth = F.row_number().over(Window.partitionBy("_own").orderBy("_doc.doc_id"))
        some = rows.where("_rows > 1").withColumn("_nth", nth)
        some = some.withColumn("_times", F.expr("_times div _rows + if(_nth <= _times % _rows, 1L, 0L)")).drop("_nth")
        once = once.unionByName(some.where("_times > 0"))
    again = F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))
    return once.withColumn("_again", again).select("_doc.*")
