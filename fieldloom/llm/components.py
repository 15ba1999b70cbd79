"""Connected components as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import checked, cut, release


def _followed(at: DataFrame, moves: DataFrame) -> DataFrame:
    """at (node, root) with each root replaced by what `moves` (node, root) has for it, if anything."""
    to = moves.select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    return at.join(checked(to), at["root"] == F.col("_from"), "left").select("node", F.coalesce("_to", "root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of the edges (columns a and b of one type) one node of its component, the same for
    the whole component.

    Each round every node moves to the first, by a hash that changes with the round, of all nodes at most two edges
    away, and edges inside a node go. A star is one node after a round, whichever of its nodes comes first, and any
    graph shrinks by a constant factor a round on average. Minima are taken before the shuffle as far as they go, so a
    hub costs one row a task. Edges and moves are cut each round; the moves are put together at the end, the last and
    smallest ones first."""
    spark = edges.sparkSession
    live = cut(edges.select("a", "b").where("a <> b").distinct())
    moves: list[DataFrame] = []
    while live.limit(1).count():
        turn = len(moves)
        both = live.union(live.select("b", "a"))
        rank = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("n"))
        one = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        one = cut(one.select(F.col("a").alias("via"), F.least(rank("a"), F.col("m")).alias("m")))
        two = both.join(checked(one), both["b"] == F.col("via")).groupBy("a").agg(F.min("m").alias("m"))
        move = cut(two.select(F.col("a").alias("node"), F.col("m.n").alias("root")))
        moves.append(move)
        to = lambda k, move=move: checked(move.select(F.col("node").alias(k), F.col("root").alias(f"to_{k}")))
        live = live.join(to("a"), "a").join(to("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        live = cut(live.where("a <> b").distinct())
        release(spark)
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    at = moves.pop()
    while moves:
        at = cut(_followed(moves.pop(), at))
    return at


def joined(at: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, root) of a graph with more edges, from those that it had without them: only the new edges
    between components are worked on."""
    of = lambda k: checked(at.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")))
    between = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    moves = components(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    fresh = moves.join(checked(at.select("node")), "node", "left_anti")
    return cut(_followed(at, moves).unionByName(fresh.select("node", "root")))
