"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageweave.llm.shared import stored


def components(
    edges: DataFrame, start: DataFrame | None = None, rounds: int | None = None
) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b) the smallest node it is
    connected with.

    Each round takes the smallest label among a node's neighbours and then the label of
    that label, so the rounds grow with the logarithm of the longest path. Labels are
    written out after each round, which cuts the lineage. ``start`` gives labels found on
    some of the edges. With ``rounds``, labels may not have reached the smallest node yet,
    but nodes of one label are connected.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = stored(edges.unionByName(edges.selectExpr("b AS a", "a AS b")), "component-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("component")
    )
    if start is not None:
        known = start.withColumnRenamed("component", "known")
        labels = labels.join(known, "node", "left").select(
            "node", F.least("component", "known").alias("component")
        )
    labels = stored(labels, "component-labels")
    done = 0
    while True:
        near = (
            both.join(labels.withColumnsRenamed({"node": "b", "component": "other"}), "b")
            .groupBy("a")
            .agg(F.min("other").alias("other"))
            .withColumnRenamed("a", "node")
        )
        moved = labels.join(near, "node").select(
            "node", F.least("component", "other").alias("via"), F.col("component").alias("before")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("label"))
        after = stored(
            moved.join(jump, "via").select(
                "node", F.least("via", "label").alias("component"), "before"
            ),
            "component-labels",
        )
        labels, done = after.select("node", "component"), done + 1
        if done == rounds or after.where("component <> before").isEmpty():
            return labels
