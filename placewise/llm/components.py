"""Connected components of an edge table, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``: component is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label of the label, so the number of rounds
    follows the logarithm of the longest path. Labels and edges stay distributed; every round ends in the shared folder.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null and a <> b")
    both = cut_lineage(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        better = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("step"))
        # the label of the label: a node's label is a node too
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("jump"))
        spread = cut_lineage(
            better.join(jump, "step", "left").select("node", "old", F.coalesce(F.least("step", "jump"), "step").alias("label"))
        )
        labels = spread.select("node", "label")
        if spread.filter("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
