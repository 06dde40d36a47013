"""Connected components by minimum labels and pointer jumping, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node reachable, from edges (a, b); nodes without an edge are left out.

    Each round takes the smallest label of the neighbours and then the label of that label, so long chains
    halve.  Tables are staged, nothing but one sum per round reaches the driver."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stage(low.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        before, total = total, labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if before == total:
            break
    return labels
