"""Connected components of an edge table by hooking and contracting.

Each node hooks onto its smallest neighbour if that is smaller; parents only get smaller, so the
hooks form a forest, whose roots pointer jumping finds in as many steps as the logarithm of its
depth. Edges are then drawn between roots and equal ones dropped. Every round leaves at most half
of the nodes that still have edges. All steps are joins and pre-aggregated groupings of written
tables: a hub is one key of a `min`, and nothing is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscan.llm.tables import forget, is_empty, saved


def _roots(hooks: DataFrame) -> DataFrame:
    """node, up: every node with the root of its tree."""
    while True:
        above = hooks.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        joined = hooks.join(above, hooks["up"] == above["_node"], "left")
        jumped = saved(joined.select("node", F.coalesce("_up", "up").alias("up"), (F.col("_up") < F.col("up")).alias("_moved")), "jump")
        forget(hooks)
        hooks = jumped
        if is_empty(hooks.filter("_moved")):
            return hooks


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, root: each node that has an edge, with the smallest node it can reach.

    Loops, repeated edges and edges with a null end don't matter. No edges give no rows.
    """
    low, high = F.least(left, right), F.greatest(left, right)
    live = saved(edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(low.alias("a"), high.alias("b")).filter("a < b").distinct(), "edges")
    nodes = saved(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().select("node", F.col("node").alias("root")), "nodes")
    while not is_empty(live):
        ends = live.select(F.col("b").alias("node"), F.col("a").alias("up"))
        roots = _roots(saved(ends.groupBy("node").agg(F.min("up").alias("up")), "hooks"))
        to = roots.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        moved = nodes.join(to, nodes["root"] == to["_node"], "left").select("node", F.coalesce("_up", "root").alias("root"))
        moved = saved(moved, "nodes")
        left_end = live.join(to, live["a"] == to["_node"], "left").select(F.coalesce("_up", "a").alias("a"), "b")
        both = left_end.join(to, left_end["b"] == to["_node"], "left").select("a", F.coalesce("_up", "b").alias("b"))
        fewer = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
        fewer = saved(fewer, "edges")
        forget(live, nodes, roots)
        live, nodes = fewer, moved
    forget(live)
    return nodes
