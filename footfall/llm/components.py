"""Connected components of an edge table by hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import stored


def _jumped(parents: DataFrame) -> DataFrame:
    """Point every node at its root: parent chains halve in each round."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parents = stored(parents.join(up, "parent").select(
            "node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "jump")
        if parents.filter("moved").isEmpty():
            return parents.select("node", "parent")
        parents = parents.select("node", "parent")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): the least node of the component of each node that has a link.

    Each round hooks every node to its least neighbour, flattens the trees and contracts the links between roots, so the
    nodes that still have links at least halve. All tables stay distributed; a node with very many links meets only partial
    aggregates and joins of stored tables, which adaptive execution can split.
    """
    links = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a")).toDF("node", "other")
        hooked = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("parent"))
        parents = _jumped(stored(hooked, "hooked"))
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("root"))
        else:
            moved = parents.select(F.col("node").alias("root"), "parent")
            labels = stored(labels.join(moved, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "labels")
        to_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("root_a"))
        to_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("root_b"))
        links = stored(links.join(to_a, "a").join(to_b, "b").filter("root_a != root_b")
                       .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return labels
