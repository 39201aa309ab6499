"""Connected components of an edge table, by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b); the root is the least node of its component.

    Each round takes the least label among a node and its neighbours, then the
    label of that label; rounds grow with the logarithm of the longest path.
    Labels stay distributed; a round is staged, so lineage does not grow.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = common.staged(both)
    labels = common.staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        near = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        far = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = common.staged(near.join(far, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        labels = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return labels
