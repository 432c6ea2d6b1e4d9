"""Connected components of links whose nodes have few neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links(a, b)`: the smallest node of its component; nodes are of any type with an order.

    Each round takes the least label among a node and its neighbours, then that label's own label, so chains shrink by half
    and more. It ends when no label changes. A node's links meet in one task, so their number should have a bound.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = stored(labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("next")), "steps")
        parents = step.select(F.col("node").alias("parent"), F.col("next").alias("grand"))
        jumped = stored(step.join(parents, F.col("next") == F.col("parent")).select("node", "old", F.col("grand").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels
