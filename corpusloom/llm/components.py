"""Connected components of an undirected graph, as DataFrame jobs.

Every round takes the smallest label among each node's neighbours, then follows the label one step (the
label of the label), so chains shorten by a power of two. A round is written to the shared checkpoint
folder, which cuts the lineage and survives lost executors; only the number of changed labels reaches
the driver. A label that many nodes share is a hot join key only in the second step, a plain join whose
hot side Spark's skew handling splits; no step gathers a group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for each node of ``edges`` (columns a, b; one direction
    is enough)."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b") \
                   .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        least = materialize(least, "labels-near")
        target = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = materialize(least.join(target, "label", "left").select(
            "node", "old", F.coalesce("further", "label").alias("label")), "labels")
        if not labels.where(F.col("old") != F.col("label")).limit(1).count():
            return labels.select("node", "label")
