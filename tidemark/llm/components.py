"""Connected components by contraction, on the cluster.

Each round every node points to the smallest of its neighbours and itself, pointers are followed to
their ends, and the links between the ends are the next round's graph. Each round's tables are
written in the shared folder, so no lineage grows. Smallest neighbours are partial aggregates and
joins on a large node are split by adaptive execution, so a hub doesn't gather its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long, not null). One row for each node of a link: node, component (its smallest node)."""
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), "cc-to")
        while True:  # follow pointers; each pass doubles the reach
            step = to.alias("x").join(to.alias("y"), F.col("x.to") == F.col("y.node"), "left").select("x.node", F.coalesce("y.to", "x.to").alias("to"), (F.col("y.to") < F.col("x.to")).alias("moved"))
            step = stored(step, "cc-step")
            moved = not step.where("moved").isEmpty()
            to = step.select("node", "to")
            if not moved:
                break
        if labels is None:
            labels = to.select("node", F.col("to").alias("component"))
        else:
            labels = labels.join(to.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = stored(labels, "cc-labels")
        ends = edges.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b")
        edges = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-links")
    return labels if labels is not None else edges.toDF("node", "component")
