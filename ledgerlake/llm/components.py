"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component``, the smallest id it is connected with, for every id in an edge.

    Each round takes the least label among a node and its neighbours, then the
    label of that label, so that rounds grow with the logarithm of a path's
    length.  Every round is written to the checkpoint folder; nothing but the
    count of changes comes to the driver.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = durable(both.union(both.select("v", "u")).distinct())
    labels = durable(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("least"))
        step = labels.join(near, "id").select("id", F.least("component", "least").alias("next"), F.col("component").alias("before"))
        up = step.select(F.col("id").alias("next"), F.col("next").alias("over"))
        moved = durable(step.join(up, "next", "left").select("id", F.coalesce("over", "next").alias("component"), (F.coalesce("over", "next") < F.col("before")).alias("changed")))
        labels = moved.select("id", "component")
        if not moved.filter("changed").limit(1).count():
            return labels
