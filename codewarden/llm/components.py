"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b); ``label`` is the smallest node reachable.

    Every round takes the smallest label among the neighbours and then the label of that label, so
    labels travel ever further; each round is saved, and rounds go on until no label changes.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        told = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("to")).agg(
            F.min("label").alias("near"))
        near = labels.join(told, F.col("node") == F.col("to"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        near = saved(near)
        far = near.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        after = saved(near.join(far, F.col("label") == F.col("via")).select(
            "node", "old", F.least("label", "beyond").alias("label")))
        if after.where("old <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
