"""Connected components of a links table, without ever gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component
    is its smallest node.

    Every round replaces a node's label by the smallest among its own and its
    neighbours', then by that label's label.  Minima combine before the
    shuffle, so a node with very many links is no hot spot, and each round is
    a written table, so the plan stays short and survives lost executors.
    NULL ends and self links are ignored.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = stored(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        reach = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        reach = stored(reach, "reach")
        # Follow the label's own label.  Few distinct labels are asked for by many nodes, so both sides are small per key.
        up = reach.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        after = reach.join(up, "component", "left").select(
            "node", F.least("component", F.coalesce("higher", "component")).alias("component"), "old"
        )
        after = stored(after, "labels")
        changed = after.where("component <> old").limit(1).count()
        labels = after.drop("old")
        if not changed:
            return labels
