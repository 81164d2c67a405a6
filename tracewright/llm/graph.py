"""Connected components of large undirected graphs, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each vertex of ``edges`` (a, b: long); root is the smallest vertex reachable.

    In each round every vertex moves to its smallest neighbour or stays, and the edges are drawn anew between the places
    reached, until none is left. From the fourth round on, "smallest" is by a hash that changes with the round: long chains
    then shrink by a constant factor too. Rounds are written to the shared scratch folder, so lost executors cost one round.
    A hub's edges are aggregated before they are shuffled, and the joins are such that Spark can split a hub's partition.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = last = None
    turn = 0
    while not edges.isEmpty():
        key = F.col("w") if turn < 3 else F.xxhash64("w", F.lit(turn))
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a"))
        both = both.withColumn("key", key).groupBy("v").agg(F.min(F.struct("key", "w")).alias("m"))
        own = F.col("v") if turn < 3 else F.xxhash64("v", F.lit(turn))
        moves = materialise(both.select("v", F.when(F.col("m.key") < own, F.col("m.w")).otherwise(F.col("v")).alias("p")), "moves")
        left, right = moves.select(F.col("v").alias("a"), F.col("p").alias("pa")), moves.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        labels = moves.select("v", F.col("p").alias("root")) if labels is None else labels.join(moves.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
        before, labels = last, materialise(labels, "labels")
        last = labels
        moved = edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        spent, edges = edges, materialise(moved.distinct(), "edges")
        discard(before, moves, spent)
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    if turn <= 3:
        return labels
    least = labels.groupBy("root").agg(F.min("v").alias("least"))
    return labels.join(least, "root").select("v", F.col("least").alias("root"))
