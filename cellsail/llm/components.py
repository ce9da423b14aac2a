"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsail.llm.store import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges (u, v); component is its least node.

    A round links each node's larger neighbours, and then its smaller ones, to the
    least of all (Kiveris et al., 2014), until all links lead to a node that leads
    to no other: about log2 of the longest chain rounds. The least neighbour is a
    partial aggregate and each round's links are a written table, so a lost executor
    costs one round. A node with very many links is on the side of the joins that
    Spark splits.
    """
    links = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = materialize(small, "small-star")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether each node leads to one other, which leads to none."""
    up, down = (links.select(F.col(x).alias("x"), F.lit(int(x == "u")).alias("up"), F.lit(int(x == "v")).alias("down")) for x in ("u", "v"))
    ends = up.unionByName(down).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """components of the links behind parts and of links (u, v) found since.

    Each component of parts is one node here, so that only links between two of
    them go through the rounds. Their labels are their least nodes, so the least
    label is the least node of all.
    """
    bridges = labelled(labelled(links.select("u", "v"), parts, "u", "cu"), parts, "v", "cv").filter("cu <> cv")
    bridges = materialize(bridges.select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), "bridges")
    if bridges.isEmpty():
        return parts
    top = materialize(components(bridges), "bridged")
    moved = labelled(parts.withColumnRenamed("component", "was"), top, "was", "component").select("node", "component")
    return materialize(moved.unionByName(top.join(parts.select("node"), "node", "left_anti")), "components")


def labelled(nodes: DataFrame, parts: DataFrame, node: str, name: str) -> DataFrame:
    """nodes and the component of each; a node without links is its own."""
    p = parts.select(F.col("node").alias(f"{name}_node"), F.col("component").alias(f"{name}_part"))
    return nodes.join(p, nodes[node] == p[f"{name}_node"], "left").withColumn(name, F.coalesce(f"{name}_part", node)).drop(f"{name}_node", f"{name}_part")
