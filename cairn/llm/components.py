"""Connected components of an edge table, wholly in joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (a, b), which are bigint.

    Each round takes the smallest root among a node's neighbours and then the root of that root, so
    paths halve; a long chain needs as many rounds as its length has binary digits, about. Sums are made before
    the shuffle, so a node with very many neighbours makes no large group.
    """
    both = shared.stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    roots = shared.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("n2"), "root"), F.col("b") == F.col("n2")).groupBy(F.col("a").alias("n1")).agg(F.min("root").alias("m"))
        better = roots.select("node", "root").join(near, F.col("node") == F.col("n1")).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        # A root that has found a smaller one takes all its nodes along.
        hooks = better.groupBy(F.col("old").alias("h")).agg(F.min("root").alias("via")).hint("rebalance")  # so that the other side's hot roots can be split
        hooked = better.join(hooks, better.old == hooks.h).select("node", "old", F.least("root", "via").alias("root"))
        jump = hooked.select(F.col("node").alias("j"), F.col("root").alias("next"))
        new = shared.stored(
            hooked.join(jump, hooked.root == jump.j).select("node", F.least("root", "next").alias("root"), (F.least("root", "next") < F.col("old")).alias("moved")), "roots"
        )
        shared.forget(roots)
        if new.filter("moved").isEmpty():
            shared.forget(both)
            return new
        roots = new
