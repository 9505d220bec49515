"""Connected components by hooking to the least neighbour, pointer jumping and contraction, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def rooted(parents: DataFrame) -> DataFrame:
    """(v, component): the root above each v of a forest (v, p), p < v, one parent each; roots themselves aren't listed."""
    held = C.written(parents.select("v", "p"))
    while True:
        up = held.select(F.col("v").alias("p"), F.col("p").alias("q"))
        jumped = C.written(held.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
        C.dropped(held)
        held = jumped
        if held.where("moved").isEmpty():
            return held.select("v", F.col("p").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for each vertex of edges(a, b) with a <> b: component is the least vertex it is joined to.

    Each round every vertex hooks to its least smaller neighbour, the hooks' roots are found, and the edges between
    different roots are the next round's graph. Nothing but counts reaches the driver.
    """
    graph = C.written(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    out = None
    while True:
        roots = rooted(graph.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("p")))
        if out is None:
            out = roots
        else:
            above = roots.select(F.col("v").alias("component"), F.col("component").alias("root"))
            more = out.join(above, "component", "left").select("v", F.coalesce("root", "component").alias("component"))
            out = C.written(more.unionByName(roots).distinct())
        lo = roots.select(F.col("v").alias("lo"), F.col("component").alias("a"))
        hi = roots.select(F.col("v").alias("hi"), F.col("component").alias("b"))
        ends = graph.join(lo, "lo", "left").join(hi, "hi").select(F.coalesce("a", "lo").alias("a"), "b").where("a <> b")
        left = C.written(ends.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
        C.dropped(graph)
        graph = left
        if graph.isEmpty():
            return out.unionByName(out.select(F.col("component").alias("v"), "component").distinct())
