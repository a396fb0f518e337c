"""Connected components of an edge table, in rounds that each end in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of all vertices of ``edges`` (a, b): the smallest vertex of each one's component.

    A round gives every vertex the smallest label around it and then that label's own label, so chains shorten by half or more.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = stored(labels.join(around, "v").select("v", "label", F.least("label", "near").alias("low")), "labels")
        jump = lower.select(F.col("v").alias("low"), F.col("low").alias("lowest"))
        found = stored(lower.join(jump, "low").select("v", "label", "lowest"), "labels")
        labels = found.select("v", F.col("lowest").alias("label"))
        if found.filter("label != lowest").isEmpty():
            return labels
