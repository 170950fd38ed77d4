"""Connected components of an edge table, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyroll.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges``.

    ``edges`` has columns a and b. Labels start as the nodes themselves; a round
    takes the smallest label among a node's neighbours, then the label of that
    label, so long chains halve. A node with many edges is a skewed join key,
    which adaptive execution splits (neither input is pre-aggregated on it), and
    minima are combined before each shuffle.
    """
    both = edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.where(F.col("a") != F.col("b")).distinct(), "component-edges")
    labels = saved(both.groupBy(F.col("a").alias("node"))
                   .agg(F.least(F.min("b"), F.col("node")).alias("component")), "component-0")
    turn = 0
    while True:
        turn += 1
        near = (both.join(labels.select(F.col("node").alias("a"), "component"), "a")
                .groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near")))
        step = saved(labels.join(near, "node").select(
            "node", F.col("component").alias("old"),
            F.least("component", "near").alias("component")), f"component-{turn}a")
        target = step.select(F.col("node").alias("component"), F.col("component").alias("far"))
        after = saved(step.join(target, "component").select(
            "node", "old", F.least("component", "far").alias("component")), f"component-{turn}b")
        labels = after.select("node", "component")
        if after.where(F.col("old") != F.col("component")).isEmpty():
            return labels
