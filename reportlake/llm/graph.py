"""Connected components of a table of links, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.shared import materialize


def _contracted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``links(a, b)`` with both ends under their label, without those whose ends have one label."""
    named = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left")
    named = named.join(labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
    named = named.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).where("x <> y")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` for every end of ``links(a, b)``; a component's name is its smallest node.

    ``known`` is the result for earlier links: it is carried on, and they are not
    read again.  In each round every node goes to its smallest neighbour if that is
    smaller, paths shorten by doubling, and links are contracted: those inside a
    component drop out, so a link is joined once, not in every round.  Two rounds
    halve the nodes at least.  Aggregations combine before the shuffle and joins
    are plain equi-joins, whose hot keys Spark splits; each step's rows are written
    down, so lineage stays short.
    """
    if known is None:
        edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    else:
        edges = _contracted(links, known)
    edges = materialize(edges, "links")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    if known is not None:
        ends = ends.join(known, "node", "left_anti")
    labels = ends.select("node", F.col("node").alias("component"))
    labels = materialize(labels if known is None else known.unionByName(labels), "labels")
    while not edges.isEmpty():
        up = materialize(edges.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node"), "up")
        while True:
            step = up.join(up.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
            step = materialize(step.select("node", F.coalesce("top", "component").alias("component"), F.col("top").isNotNull().alias("moved")), "up")
            up = step.select("node", "component")
            if step.where("moved").isEmpty():
                break
        labels = labels.join(up.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
        labels = materialize(labels.select("node", F.coalesce("top", "component").alias("component")), "labels")
        edges = materialize(_contracted(edges, up), "links")
    return labels
