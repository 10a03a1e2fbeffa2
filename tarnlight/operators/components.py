"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ends of edges (a, b): component is the least id that can be reached.

    Each round takes the least label of the neighbours, then the label of the
    label, so the rounds grow with the logarithm of a component's diameter. The
    tables of a round are checkpointed in the shared folder.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(both.a.alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = cut(low.join(up, "component", "left").select("id", F.least("component", "above").alias("component"), "was"))
        labels = new.select("id", "component")
        if new.where("component <> was").isEmpty():
            return labels
