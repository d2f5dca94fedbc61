"""Connected components of a graph given as edges, in a number of rounds that grows with the log of its paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastmile.llm.common import FEW, cut


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(a, b) to (node, component): the smallest node that each node with an edge reaches.

    Each round points every node at its smallest neighbour, follows the pointers twice, renames the
    edges' ends by them and drops the edges within a name (few rows are broadcast, not shuffled). The renamed edges still connect whatever
    was connected, and there are fewer names each round; it ends when no edge is left. ``rows``: how many edges
    there are at most, where that is known; the tables of a round are written to as many files as its edges need.
    """
    names = None
    edges = cut(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), rows)
    nodes = 0
    while many := edges.count():
        lent = F.broadcast if 2 * many <= FEW else lambda df: df  # all tables of a round have at most two rows an edge
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to"))
        for _ in range(2):
            after = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            point = point.join(lent(after), "to").select("node", F.col("next").alias("to"))
        point = cut(point, 2 * many)
        nodes = nodes or 2 * many
        if names is None:
            names = point
        else:
            after = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            names = cut(names.join(lent(after), "to", "left").select("node", F.coalesce("next", "to").alias("to")), nodes)
        of_a = point.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        of_b = point.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        renamed = edges.join(lent(of_a), "a").join(lent(of_b), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = cut(renamed.where(F.col("a") != F.col("b")).distinct(), many)
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return names.select("node", F.col("to").alias("component"))
