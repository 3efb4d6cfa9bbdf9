"""Components of a graph held as an edge relation, group by group.

Joins sort and merge: tables of edges and nodes take far less room as files than in a broadcast, which the planner would choose by the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import used_up, written


def components(edges: DataFrame, group: str = "image_id") -> DataFrame:
    """(group, node, root) of every node of ``edges`` (group, u, v): the least node that is reachable from it.

    Each round hangs every node below the least root in its neighbourhood and then shortens the way to it by jumping to the root's root.
    Both are joins and partial aggregations on nodes; a round's table replaces the one before.
    """
    both = edges.filter("u <> v").select(group, "u", "v").distinct()
    both = written(both.union(both.select(group, F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    roots = written(both.select(group, F.col("u").alias("node"), F.col("u").alias("root")).distinct(), "roots")
    while True:
        at = roots.select(group, F.col("node").alias("v"), F.col("root").alias("near"))
        least = both.join(at.hint("merge"), [group, "v"]).groupBy(group, "u").agg(F.min("near").alias("near")).select(group, F.col("u").alias("node"), "near")
        hung = roots.join(least.hint("merge"), [group, "node"]).withColumn("low", F.least("root", "near"))
        # A root takes the least of what its nodes have found; its nodes then jump to where it points.
        points = hung.groupBy(group, "root").agg(F.min("low").alias("low")).select(group, F.col("root").alias("of"), F.col("low").alias("to"))
        there = hung.join(points.select(group, F.col("of").alias("root"), "to").hint("merge"), [group, "root"])
        far = points.select(group, F.col("of").alias("to"), F.col("to").alias("beyond"))
        moved = there.join(far.hint("merge"), [group, "to"], "left").select(group, "node", F.least("to", F.coalesce("beyond", "to")).alias("new"), "root")
        new = written(moved, "roots")
        changed = new.filter("new <> root").limit(1).count()
        used_up(roots)
        roots = new.select(group, "node", F.col("new").alias("root"))
        if not changed:
            used_up(both)
            return roots


def first_kept(nodes: DataFrame, clashes: DataFrame, group: str) -> DataFrame:
    """Greedy choice in order: nodes (group, node) that clash with no kept node before them; ``clashes`` (group, a, b) has a before b.

    In each round every open node without an open node before it that it clashes with is kept, and what clashes with the kept
    ones goes. Rounds are as many as the longest chain of clashes that decide each other; a group may have any size.
    """
    left = written(clashes.select(group, "a", "b").distinct(), "clashes")
    gone = None  # nodes that clash with a kept one
    while True:
        # Sources: named first in a clash and never second, so nothing open stands before them.
        sources = left.select(group, F.col("a").alias("node")).distinct().join(left.select(group, F.col("b").alias("node")).distinct().hint("merge"), [group, "node"], "left_anti")
        fall = written(left.join(sources.withColumnRenamed("node", "a").hint("merge"), [group, "a"]).select(group, F.col("b").alias("node")).distinct(), "fallen")
        if not fall.limit(1).count():
            break
        gone = fall if gone is None else gone.unionByName(fall)
        out = fall.select(group, "node").hint("merge")
        rest = left.join(out.withColumnRenamed("node", "a"), [group, "a"], "left_anti").join(out.withColumnRenamed("node", "b"), [group, "b"], "left_anti")
        rest = written(rest.select(group, "a", "b"), "clashes")
        used_up(left)
        left = rest
    return nodes if gone is None else nodes.join(gone.distinct().hint("merge"), [group, "node"], "left_anti")
