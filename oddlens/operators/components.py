"""Connected components of a graph whose nodes and edges are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.sources.scratch import discard, settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph of ``edges`` (a, b of one orderable type); the component is its smallest node.

    Each round maps every node to the smallest of itself and its neighbours and contracts the edges;
    the smallest node of a component maps to itself, so it is the one that is left. Hot nodes only meet
    partial minima and equi-joins that AQE can split. Nodes without an edge to another node aren't returned;
    null ends are dropped. The result is a settled table.
    """
    edges = edges.select("a", "b").where("a <> b")
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
        ends = edges.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b")
        done, edges = edges, settle(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(done)
        if roots is None:
            roots = least
        else:
            step = least.toDF("component", "to")
            done, roots = roots, settle(roots.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
            discard(done, least)
    if roots is None:
        return settle(edges.toDF("node", "component"))
    discard(edges)
    return roots
