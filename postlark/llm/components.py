"""Connected components in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), the component being its smallest node.

    Every node hooks to its smallest neighbour below it, chains shrink by pointer
    doubling, and the edges between the remaining roots go on: few rounds, each with
    fewer nodes.  Only partial minima meet in a task, however many edges a node has.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("component")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = materialize(both.groupBy("a").agg(F.min("b").alias("up")).where("up < a").select(F.col("a").alias("node"), "up"))
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            after = materialize(parent.join(above, "up", "left").select("node", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")))
            done = after.where("moved").isEmpty()
            discard(parent)
            parent = after.drop("moved")
            if done:
                break
        new_labels = materialize(labels.join(parent.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        a, b = parent.select(F.col("node").alias("a"), F.col("up").alias("ra")), parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        rest = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
        new_edges = materialize(rest)
        for old in (labels, edges, parent):
            discard(old)
        labels, edges = new_labels, new_edges
    return labels
