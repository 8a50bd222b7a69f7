"""Connected components by lowest labels and pointer jumping; every round is a staged table, nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of edges (a, b) is connected with."""
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        to = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = stage(low.join(to, "label", "left").select("node", "was", F.least("label", "jump").alias("label")), "labels")
        moved = new.filter("label <> was").limit(1).count()
        unstage(labels)
        labels = new.select("node", "label")
        if not moved:
            unstage(both)
            return labels
