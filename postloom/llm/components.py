"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes of one component share the root.

    Each round every node points to the least of itself and its neighbours, and edges are drawn
    between the nodes pointed to.  Node ids should be hashes: then a round shrinks even long
    chains by a constant factor, and a dozen rounds do for any graph.  All steps are joins and
    aggregations with partial sums; the driver only asks whether edges are left.
    """
    left = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while True:
        both = left.union(left.select("b", "a"))
        point = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("to")))
        if roots is None:
            new_roots = point.select("node", F.col("to").alias("root"))
        else:
            new_roots = scratch.keep(
                roots.join(point.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            )
        new_left = scratch.keep(
            left.join(point.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(point.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        )
        scratch.drop(left)
        left, roots = new_left, new_roots
        if left.isEmpty():
            return roots
