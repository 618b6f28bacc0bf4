"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): component is the least node reachable.

    Each step takes the least label among the neighbours and then the label's own label (pointer jumping), so a
    star is done in two steps and a path of n nodes in O(log n). Labels go to the shared folder after each step.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    both, at_both = stored(both, "edges")
    labels, at = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("node").alias("root"), F.col("component").alias("above"))
        after = step.join(jump, step.component == jump.root).select("node", F.least("component", "above").alias("component"), (F.least("component", "above") != F.col("old")).alias("moved"))
        new, at_new = stored(after, "labels")
        discard(spark, at)
        labels, at = new.select("node", "component"), at_new
        if not new.where("moved").limit(1).count():
            discard(spark, at_both)
            return labels
