"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, discard, join_counted, materialise


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_lowest(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Join (u, v) edges to the materialised (u, m, n): the smallest neighbour of each node, and how many edges the node has.

    A small graph's nodes are broadcast; in a large one only those of very
    many edges are, so that no task gets all edges of a hub.
    """
    if low.count() <= BROADCAST_ROWS:
        return edges.join(F.broadcast(low), "u")
    return join_counted(edges, low, ["u"], low.agg(F.sum("n")).first()[0])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of (a, b) links, the component being its smallest node.

    Large star: every node hands its larger neighbours to its smallest one;
    small star: its smaller neighbours. Both are a minimum per node, summed up
    before the shuffle, and joined back to the edges without gathering a
    hub's edges in one task. Rounds end when the edges stay as they are; each
    is written to the shared folder, and deleted when the next one is there.
    Only counts and a checksum reach the driver. Nodes may be of any type
    that has an order.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "edges")
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "lowest")
        large = _with_lowest(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "large-star")
        discard(edges, low)
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "lowest")
        small = _with_lowest(large, low).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large, low)
        after = _digest(edges)
        if after == before:
            break
        before = after
    low = edges.groupBy("u").agg(F.min("v").alias("component"))
    return low.select(F.col("u").alias("node"), "component").unionByName(
        low.select(F.col("component").alias("node"), "component").distinct()
    )
