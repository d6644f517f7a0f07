"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.storage import Scratch


def _jumped(scratch: Scratch, parent: DataFrame) -> DataFrame:
    """Every node's parent, followed to the end: the steps double until nothing moves. Parents are smaller than their nodes,
    so there are no cycles."""
    while True:
        up = parent.select(F.col("node").alias("up"), F.col("parent").alias("above"))
        far = parent.join(up, F.col("parent") == F.col("up"), "left")
        new = scratch.put(far.select("node", F.coalesce("above", "parent").alias("parent"), (F.coalesce("above", "parent") != F.col("parent")).alias("moved")), "jumped")
        still = new.where("moved").limit(1).count() == 0
        scratch.drop(parent)
        parent = new.drop("moved")
        parent._stored_at = new._stored_at
        if still:
            return parent


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) of every node in `edges` (a, b), root being the smallest node that links lead to.

    A round hangs every node on its smallest neighbour if that is smaller, follows these parents to their ends, and replaces nodes by
    the ends they reach: the edges that are left are those between ends. Components lose a node or more in each round, stars and
    chains nearly all of them. A node with many edges is a partial minimum and one side of a join that can be split.
    """
    left = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = scratch.put(edges.where("a IS NOT NULL AND b IS NOT NULL").select(*left).distinct(), "edges")
    alone = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    out, todo = scratch.put(alone.withColumn("root", F.col("node")), "roots"), edges.where("a <> b")
    while todo.limit(1).count():
        both = todo.select(F.col("b").alias("node"), F.col("a").alias("near")).unionByName(todo.select(F.col("a").alias("node"), F.col("b").alias("near")))
        near = both.groupBy("node").agg(F.min("near").alias("near"))
        parent = _jumped(scratch, scratch.put(near.select("node", F.least("node", "near").alias("parent")), "parents"))
        step = lambda c: parent.select(F.col("node").alias(c), F.col("parent").alias(f"new_{c}"))
        moved = todo.join(step("a"), "a").join(step("b"), "b").where("new_a <> new_b")
        new = scratch.put(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "edges")
        roots = out.join(step("root"), "root", "left").select("node", F.coalesce("new_root", "root").alias("root"))
        after = scratch.put(roots, "roots")
        scratch.drop(parent, out, edges)
        out, todo, edges = after, new, new
    scratch.drop(edges)
    return out
