"""Connected components of an edge table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.tables import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every end of an edge; a table of ``scratch``.

    In each round a node takes the smallest label among its neighbours' and its own and
    passes it to its label's node too, then takes the label of that label, so that chains
    take few rounds; rounds end when no label changes.  Aggregations are per node and
    combine before the shuffle, and both sides of every join come from files, so that a
    node with many edges is no hot group.
    """
    ends = lambda x, y: edges.select(F.col(x).alias("u"), F.col(y).alias("v"))
    both = scratch.keep(ends(a, b).unionAll(ends(b, a)).where("u != v").distinct())
    labels = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        met = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("_near")).withColumnRenamed("u", "node")
        near = labels.join(met, "node").select("node", "label", F.least("label", "_near").alias("_new"))
        nearer = scratch.keep(near)
        # A node's label is a node too: it learns of the smaller label that one of its own has met.
        hooked = nearer.where("_new < label").groupBy(F.col("label").alias("node")).agg(F.min("_new").alias("_hook"))
        roots = scratch.keep(nearer.join(hooked, "node", "left").select("node", "label", F.least("_new", F.coalesce("_hook", "_new")).alias("_new")))
        jump = roots.select(F.col("node").alias("_new"), F.col("_new").alias("_far"))
        moved = scratch.keep(roots.join(jump, "_new", "left").select("node", F.least("_new", F.coalesce("_far", "_new")).alias("label"), F.col("label").alias("_was")))
        settled = moved.where("label != _was").isEmpty()
        scratch.drop(labels, nearer, roots)
        labels = moved.select("node", "label")
        labels._foliant_path = moved._foliant_path
        if settled:
            scratch.drop(both)
            found = labels.withColumnRenamed("label", "component")
            found._foliant_path = moved._foliant_path
            return found
