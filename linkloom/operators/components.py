"""Connected components by alternating star contractions.

Follows the large-star / small-star rounds of Kiveris et al., "Connected
Components in MapReduce and Beyond" (2014). Each round is a minimum per node
(combined before the shuffle), one lookup join and a distinct. The edge set never
grows, and a round's edges are stored so that lost executors cost one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .graph import undirected_edges
from .joins import hot_keys, lookup_join


def _large_star(pairs: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    both = pairs.select("big", "small").unionByName(
        pairs.select(F.col("small").alias("big"), F.col("big").alias("small"))
    )
    least = both.groupBy(F.col("big").alias("_node")).agg(
        F.least(F.min("small"), F.col("big")).alias("_least")
    )
    hot = hot_keys(pairs, "small")["small"]
    joined = lookup_join(pairs, least, "small", "_node", hot=hot)
    return joined.select("big", F.col("_least").alias("small")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = pairs.groupBy(F.col("big").alias("_node")).agg(F.min("small").alias("_least"))
    hot = hot_keys(pairs, "big")["big"]
    moved = lookup_join(pairs, least, "big", "_node", hot=hot).select(
        F.col("small").alias("big"), F.col("_least").alias("small")
    )
    kept = least.select(F.col("_node").alias("big"), F.col("_least").alias("small"))
    return moved.filter(F.col("big") != F.col("small")).unionByName(kept).distinct()


def _is_settled(pairs: DataFrame) -> bool:
    """True when every node hangs on one root and no root hangs on anything."""
    several = pairs.groupBy("big").count().filter(F.col("count") > 1)
    if not several.isEmpty():
        return False
    hanging = pairs.select(F.col("big").alias("small"))
    return pairs.join(hanging, "small", "left_semi").isEmpty()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node_id, component)``; a component is named by its smallest node."""
    pairs = settle(
        undirected_edges(edges)
        .filter(F.col("u") != F.col("v"))
        .select(F.col("v").alias("big"), F.col("u").alias("small"))
    )
    while not _is_settled(pairs):  # each round hangs nodes on smaller ones, so it ends
        pairs = settle(_small_star(settle(_large_star(pairs))))
    roots = pairs.select(F.col("big").alias("node_id"), F.col("small").alias("component"))
    return nodes.select("node_id").join(roots, "node_id", "left").select(
        "node_id", F.coalesce("component", "node_id").alias("component")
    )


def largest_component(
    nodes: DataFrame, edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the largest component; ties go to the smallest id.

    Both ends of an edge share a component, so edges are filtered by one end.
    """
    members = connected_components(nodes, edges)
    top = (
        members.groupBy("component")
        .agg(F.count("*").alias("_size"))
        .orderBy(F.desc("_size"), "component")
        .limit(1)
        .select("component")
    )
    inside = members.join(F.broadcast(top), "component", "left_semi").select("node_id")
    kept_edges = edges.join(inside.select(F.col("node_id").alias("src")), "src", "left_semi")
    return nodes.join(inside, "node_id", "left_semi"), kept_edges.select("src", "dst")
