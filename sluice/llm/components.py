"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    Each round a node takes the smallest label among its own and its
    neighbours', then the label of its label (pointer jumping), so chains
    shorten by powers. Hubs are only ever on the side of a minimum (combined
    before the shuffle) or of a join that adaptive execution can split. Every
    round is a table in the shared folder, and the one before it is deleted.
    An empty edge table gives an empty result; loops and repeated edges do no harm.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    both, both_at = materialise(spark, both.distinct(), "cc-edges")
    labels, at = materialise(spark, both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")), "cc-labels")
    while True:
        near = both.join(labels, both.u == labels.node).groupBy(F.col("v").alias("node")).agg(F.min("root").alias("near"))
        taken = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("now"))
        taken, taken_at = materialise(spark, taken, "cc-taken")
        up = taken.select(F.col("node").alias("now"), F.col("now").alias("above"))
        step = taken.join(up, "now").select("node", F.least("now", "above").alias("next"), "root")
        step, step_at = materialise(spark, step, "cc-labels")
        changed = not step.filter(F.col("next") != F.col("root")).isEmpty()
        discard(spark, taken_at)
        discard(spark, at)
        labels, at = step.select("node", F.col("next").alias("root")), step_at
        if not changed:
            discard(spark, both_at)
            return labels
