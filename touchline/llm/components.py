"""Connected components of a graph of longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; root is the smallest node reachable.

    Rounds of contraction: every node points to its smallest neighbour or itself, pointers are
    followed to their ends, and edges between the ends that differ make the next round's graph. A
    round at least halves most graphs. Tables are written after each step, so joins read plain
    tables, whose large partitions Spark can split where one root holds most of the nodes; sums of
    neighbours are combined before they move. No edges: an empty table. Nulls and loops are left out.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = common.written(edges.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "edges")
    labels = common.written(edges.selectExpr("explode(array(a, b)) as node").distinct().selectExpr("node", "node as root"), "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.selectExpr("b as a", "a as b"))
        ends = common.written(both.groupBy("a").agg(F.min("b").alias("b")).selectExpr("a as node", "least(a, b) as to"), "pointers")
        while True:
            next_ = ends.selectExpr("node as to", "to as further")
            far = common.written(ends.join(next_, "to").selectExpr("node", "further as to", "further <> to as moved"), "pointers")
            moved = not far.where("moved").isEmpty()
            common.dropped(ends)
            ends = far.select("node", "to")
            if not moved:
                break
        to_a, to_b = ends.selectExpr("node as a", "to as ra"), ends.selectExpr("node as b", "to as rb")
        rest = edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        rest = common.written(rest.selectExpr("least(ra, rb) as a", "greatest(ra, rb) as b").distinct(), "edges")
        to_root = ends.selectExpr("node as root", "to")
        named = common.written(labels.join(to_root, "root", "left").selectExpr("node", "coalesce(to, root) as root"), "labels")
        for old in (edges, labels, ends):
            common.dropped(old)
        edges, labels = rest, named
    return labels
