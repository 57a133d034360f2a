"""Connected components with labels that are the least member, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import cut_lineage


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u < v) with the same components: each node keeps the edge to its least neighbour below, and its other neighbours
    below get one to that. Dense groups come down to about an edge a node."""
    least = F.min("u").over(Window.partitionBy("v"))
    e = edges.withColumn("m", least)
    return e.select(F.col("m").alias("u"), "v").union(e.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v), both long; component: the least node reachable.

    Each round takes the least label among the neighbours, then follows it one step (the label's own label), so
    rounds grow with the logarithm of a chain's length or so. Neighbours' labels are combined before the shuffle.
    """
    one = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    one = cut_lineage(contracted(contracted(one)))
    both = cut_lineage(one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    state = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(state, both.v == state.node).groupBy("u").agg(F.min("component").alias("near"))
        met = state.join(near, state.node == near.u).select("node", "component", F.least("component", "near").alias("label"))
        jump = state.select(F.col("node").alias("label"), F.col("component").alias("further"))
        state = cut_lineage(met.join(jump, "label").select("node", F.least("label", "further").alias("component"), (F.least("label", "further") < F.col("component")).alias("moved")))
        moved = state.where("moved").limit(1).count()
        state = state.select("node", "component")
        if not moved:
            return state
