"""Connected components of a graph held as edges, by alternating large and small stars.

Each round is joins and aggregations over edges, written to the shared folder. Minima are
aggregated before the shuffle; those of hubs, of which there are at most edges / ``HUB``,
are broadcast, so no task needs all the neighbours of a node. The driver sees a count and
a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import materialize

#: Neighbours beyond which a node is a hub.
HUB = 1_000_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """``pairs`` (u, v): each v, and u itself, is linked to the least of u and its v's."""
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
    hubs, least = least.filter(F.col("n") > HUB).drop("n"), least.drop("n")
    if hubs.isEmpty():
        linked = pairs.join(least, "u")
    else:
        others = pairs.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least, "u")
        linked = pairs.join(F.broadcast(hubs), "u").unionByName(others)
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return materialize(out.filter(F.col("a") != F.col("b")).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component) of all nodes that have an edge to another; a component is named by its least node."""
    down = lambda e: e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        edges = _star(down(_star(both, large=True)), large=False)
    hubs = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(hubs)


def joined_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (node, component) after ``links`` (a, b) between nodes: old components are the nodes of a smaller graph."""
    of_a = components.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = components.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = links.join(of_a, "a").join(of_b, "b").filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    new = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return materialize(components.join(new, "component", "left").select("node", F.coalesce("joined", "component").alias("component")))
