"""Exact top-k by inner product with pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries of a block, and pivots.
BLOCK, QUERIES, PIVOTS, STEP = 4096, 2048, 32, 128


def as_integers(embedding: str = "embedding", scale: int = 1024) -> Column:
    """floor(scale * x) of each component as double."""
    return F.transform(F.col(embedding), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector takes part: not null, and no component null, NaN or infinite."""
    bad = F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(True))


def nearest(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best (id, score) of one query, exactly. bound holds an upper bound of each vector's score; vectors are
    evaluated in its order until the k-th best score found is above every bound left."""
    order = np.argsort(-bound, kind="stable")
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(order), STEP):
        if len(best) == k and best[-1] > bound[order[at]]:
            break
        part = order[at : at + STEP]
        best = np.concatenate([best, vectors[part] @ query])
        best_ids = np.concatenate([best_ids, ids[part]])
        top = np.lexsort((best_ids, -best))[:k]
        best, best_ids = best[top], best_ids[top]
    return best_ids, best


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """Each query's k highest integer inner products over all other rows, equal scores by the smaller vec_id.

    A few vectors, taken in the order of a hash, are pivots. For a query q and a vector v the differences of their
    distances to each pivot bound their own distance from below, and with the two norms their inner product from
    above. Candidates are dealt into blocks of about BLOCK rows and queries into blocks of about QUERIES; every pair
    of blocks is one group, bounded at any size, that gives its own top k, and the groups' results are ranked.

    Returns query_id, rank, vec_id and score; fewer than k rows where there are fewer candidates. Vectors that are
    null or hold a null or non-finite component take no part; a vector is compared only with those of its length; a
    query leaves out all rows with its own id; repeated rows count each, as do rows with equal vectors; rows with a
    null vec_id take no part; an empty table gives an empty result. Scores are exact while every |component| * scale
    stays below 2^26 for vectors of up to 2,048 components."""
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("id"), as_integers(scale=scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    n, asked = rows.select(F.count(F.lit(1)), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    blocks, askers = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERIES))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    tables: dict[int, np.ndarray] = {}
    for size in {len(r["v"]) for r in chosen}:
        tables[size] = np.array([r["v"] for r in chosen if len(r["v"]) == size], np.int64).reshape(-1, size)
    spread = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))
    here, there = (spread % blocks).cast("int"), (spread % askers).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("id", "v", here.alias("b"), every(askers).alias("a"))
    queries = rows.where("q").select("id", "v", there.alias("a"), every(blocks).alias("b"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        sizes, wanted = left["v"].map(len).to_numpy(), right["v"].map(len).to_numpy()
        for size in np.unique(wanted):
            if not (sizes == size).any():
                continue
            stack = lambda v, size=size: np.stack(list(v)).astype(np.int64).reshape(-1, size)
            ids, vecs = left["id"].to_numpy()[sizes == size], stack(left["v"].to_numpy()[sizes == size])
            asks, qs = right["id"].to_numpy()[wanted == size], stack(right["v"].to_numpy()[wanted == size])
            pivot = tables.get(int(size), np.zeros((1, size), np.int64))
            dv, dq = _distances(vecs, pivot), _distances(qs, pivot)
            nv, nq = (vecs.astype(np.float64) ** 2).sum(1), (qs.astype(np.float64) ** 2).sum(1)
            for i, ask in enumerate(asks):
                gap = np.zeros(len(ids))
                for p in range(len(pivot)):
                    np.maximum(gap, np.abs(dv[:, p] - dq[i, p]), out=gap)
                slack = 1e-9 * (nv + nq[i]) + 1  # for rounding
                bound = np.where(ids == ask, -np.inf, (nv + nq[i] - gap * gap) / 2 + slack)
                live = ids != ask
                found, score = nearest(qs[i], vecs[live], ids[live], k, bound[live])
                out.append((np.full(len(found), ask), found, score))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    schema = "query_id long, vec_id long, score long"
    # a query row that is repeated is one query
    queries = queries.dropDuplicates(["id", "v", "a", "b"])
    local = candidates.groupBy("a", "b").cogroup(queries.groupBy("a", "b")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
