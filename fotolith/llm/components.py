"""Connected components by repeated contraction, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node with a link; ``edges`` has long columns u and v; component is the smallest node.

    Each round maps a node to the smallest of its neighbours' smallest neighbours and contracts the edges by that map,
    so a path halves in each round and a star ends in one. Edges and labels are written out after each round; the
    driver sees their counts only.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = scratch.write(edges, f"{name}_e0")
    labels = None
    k = 0
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
        jump = least.alias("a").join(least.alias("b"), F.col("a.to") == F.col("b.u")).select(F.col("a.u").alias("from"), F.col("b.to").alias("to"))
        jump = scratch.write(jump, f"{name}_j{k}")
        if labels is None:
            new = jump.select(F.col("from").alias("node"), F.col("to").alias("component"))
        else:
            new = labels.join(jump, labels.component == jump["from"], "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = scratch.write(new, f"{name}_l{k + 1}")
        left, right = jump.select(F.col("from").alias("u"), F.col("to").alias("u2")), jump.select(F.col("from").alias("v"), F.col("to").alias("v2"))
        moved = edges.join(left, "u").join(right, "v").where(F.col("u2") != F.col("v2"))
        edges = scratch.write(moved.select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct(), f"{name}_e{k + 1}")
        scratch.drop(f"{name}_e{k}", f"{name}_j{k}", f"{name}_l{k}")
        k += 1
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
