"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.plans.cut import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b); nodes have the same label exactly if a path joins them.

    In each round a node goes to the neighbour, or itself, with the least id, from the third round on with the least
    hash of the round, and edges are drawn between where their ends went. A fresh hash each round lets long chains
    shrink by a fixed part, so rounds grow with the logarithm of the longest chain. Nothing but whether edges are left comes to the driver.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return cut(df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    edges, labels, turn = tidy(edges), None, 0
    while not edges.isEmpty():
        # ids first: links mostly form stars around a least id
        rank = lambda c: F.struct((F.col(c) if turn < 2 else F.xxhash64(c, F.lit(turn))).alias("rank"), F.col(c).alias("to"))  # noqa: E731,B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = cut(both.groupBy("a").agg(F.min(rank("b")).alias("other"))
                    .select(F.col("a").alias("node"), F.least(rank("a"), F.col("other"))["to"].alias("to")))
        from_a = moves.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        from_b = moves.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = tidy(edges.join(from_a, "a").join(from_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")))
        if labels is None:
            labels = moves.select("node", F.col("to").alias("label"))
        else:
            further = moves.select(F.col("node").alias("label"), F.col("to").alias("next"))
            labels = labels.join(further, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        turn += 1
        if turn % 4 == 0:
            labels = cut(labels)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
