"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every end of an edge (a, b): the smallest node that it is connected to; a table of scratch.

    Every round takes the least of a node's label, its neighbours' labels and its label's own label, so distances shrink by powers. Each
    round is written out, and its predecessor goes; joins are between written tables, so Spark can split a hub's rows among tasks.
    """
    pairs = scratch.written(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.written(pairs.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component"), F.lit(True).alias("changed")), "labels")
    while True:
        known = labels.select("node", "component")
        near = pairs.join(known, pairs.b == known.node).groupBy("a").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        both = known.join(near, known.node == near.a, "left").join(jump, known.component == jump.at, "left")
        least = F.least("component", F.coalesce("near", "component"), F.coalesce("further", "component"))
        moved = scratch.written(both.select("node", least.alias("component"), (least < F.col("component")).alias("changed")), "labels")
        scratch.drop(labels)
        labels = moved
        if labels.where("changed").isEmpty():
            scratch.drop(pairs)
            return labels.select("node", "component")
