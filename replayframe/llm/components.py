"""Connected components of a graph given as edges, by hooking trees and shortening them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, label): the smallest node reachable.

    Each node points to a smaller one, at first to its smallest neighbour.  A
    round looks at where the neighbours' pointers lead in two steps: the
    smallest of these becomes the pointer of the node and of what it pointed
    to, so whole trees are hooked at once, and pointers skip a step.  Rounds
    grow with the logarithm of the longest path; a round's pointers are written
    in the shared folder, and rounds end when none changes.  Nodes without an
    edge don't appear.
    """
    one = edges.where("a <> b").select("a", "b")
    graph = materialize(one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph")
    labels = materialize(graph.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
        # roots point to themselves, so every pointer leads somewhere
        two = materialize(labels.join(ahead, "label").select("node", "label", "ahead"), "ahead")
        near = graph.join(two.select(F.col("node").alias("b"), "ahead"), "b").groupBy(F.col("a").alias("node")).agg(F.min("ahead").alias("near"))
        seen = materialize(two.join(near, "node"), "near")
        hooked = seen.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        new = seen.join(hooked, "node", "left").select("node", F.col("label").alias("before"), F.least("ahead", "near", F.coalesce("hook", "ahead")).alias("label"))
        new = materialize(new, "labels")
        changed = new.where("label <> before").limit(1).count()
        discard(labels, two, seen)
        labels = new
        if not changed:
            discard(graph)
            return labels.select("node", "label")
