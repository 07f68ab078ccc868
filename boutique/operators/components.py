"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique.session import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the root is one node of its component.

    Rounds of star contraction: in each, every node points to its smallest neighbour (itself
    included), then to where that one points; edges between different targets are the next
    round's. Nodes should be hashes: in a random order the edges run out after about
    log(nodes) rounds. A node of any degree is an aggregate (with map-side combining), never
    a group in one task.
    """
    edges = materialize(edges.distinct())
    roots = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        further = points.select(F.col("a").alias("to"), F.col("to").alias("root"))
        points = materialize(points.join(further, "to").select(F.col("a").alias("node"), "root"))
        if roots is None:
            roots = points
        else:
            moved = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = materialize(roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        ends = edges.join(points.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(
            points.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = materialize(ends.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            return roots
