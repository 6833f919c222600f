"""Connected components of an edge table, computed without gathering any of it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import cut


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge table; a component's id is its least node.

    Each round takes the least label among a node's neighbours and then that label's own label
    (pointer jumping), so long chains halve. Nulls are no nodes; loops and repeated edges are
    harmless; an empty edge table gives an empty result. Lineage is cut by a checkpoint each
    round; it ends when no label moves.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), loop=True)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), loop=True)
    moved = labels.limit(1).count()
    while moved:
        reach = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        near = labels.join(reach.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        new = cut(near.join(jump, "to", "left").select("node", "old", F.least("to", F.coalesce("further", "to")).alias("component")), loop=True)
        moved = new.where(F.col("old") != F.col("component")).limit(1).count()
        labels = new.select("node", "component")
    return labels
