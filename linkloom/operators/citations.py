"""Cleaning of raw links: known endpoints, node ids, isolated articles, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import HotKeys, hot_keys, lookup_join
from .ordering import dense_id_map


def drop_null_edges(edges: DataFrame) -> DataFrame:
    return edges.dropna()


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Drop repeated pairs; (a, b) and (b, a) are different here."""
    return edges.dropDuplicates(["source", "target"])


def known_endpoints(edges: DataFrame, nodes: DataFrame, *, key: str = "text_id") -> DataFrame:
    """Keep edges whose both ends are articles of ``nodes``.

    Two semi joins; Spark splits a skewed left side at run time.
    """
    ids = nodes.select(F.col(key).alias("_id"))
    return edges.join(ids, F.col("source") == F.col("_id"), "left_semi").join(
        ids, F.col("target") == F.col("_id"), "left_semi"
    )


def clean_edges(edges: DataFrame, nodes: DataFrame, *, key: str = "text_id") -> DataFrame:
    """Edges without nulls, repeats and unknown ends.

    Repeats go first: their removal combines map-side and is the only step whose
    shuffle would otherwise carry a repeated pair.
    """
    return known_endpoints(dedup_edges(drop_null_edges(edges)), nodes, key=key)


def encode_edges(
    edges: DataFrame,
    ids: DataFrame,
    *,
    key: str = "text_id",
    id: str = "node_id",
    hot: dict[str, HotKeys] | None = None,
) -> DataFrame:
    """External ids to node ids on both ends, as ``(src, dst)``.

    A hub cited by a large share of all edges is spread over many tasks.
    """
    hot = hot_keys(edges, "source", "target") if hot is None else hot
    pairs = edges.select("source", "target")
    left = ids.select(F.col(key).alias("_source"), F.col(id).alias("src"))
    right = ids.select(F.col(key).alias("_target"), F.col(id).alias("dst"))
    half = lookup_join(pairs, left, "source", "_source", hot=hot["source"])
    full = lookup_join(
        half.select("src", "target"), right, "target", "_target", hot=hot["target"]
    )
    return full.select("src", "dst")


def endpoints(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Distinct ids that occur in an edge."""
    return (
        edges.select(F.explode(F.array(source, target)).alias("_id"))
        .distinct()
    )


def drop_isolated(nodes: DataFrame, edges: DataFrame, *, key: str = "text_id") -> DataFrame:
    """Remove articles in no edge; a self-loop counts as an edge."""
    return nodes.join(endpoints(edges), F.col(key) == F.col("_id"), "left_semi")


def reindex(
    nodes: DataFrame, edges: DataFrame, *, key: str = "text_id", order: str = "ord"
) -> tuple[DataFrame, DataFrame]:
    """Number the nodes 0..n-1 in input order and rewrite the edges to the numbers."""
    ids = dense_id_map(nodes, order, key)
    numbered = nodes.join(ids.select(key, "node_id"), key)
    return numbered, encode_edges(edges, ids, key=key)


def links_by_title(
    links: DataFrame, pages: DataFrame, *, title: str = "title", id: str = "text_id"
) -> DataFrame:
    """Title links to page ids; unmatched ends become null.

    A repeated title stands for its last page.
    """
    by_title = pages.groupBy(F.col(title).alias("_title")).agg(F.max(id).alias("_id"))
    hot = hot_keys(links, "source", "target")
    sources = by_title.toDF("_source", "_source_id")
    targets = by_title.toDF("_target", "_target_id")
    half = lookup_join(links, sources, "source", "_source", hot=hot["source"], how="left")
    full = lookup_join(
        half.select("_source_id", "target"), targets, "target", "_target",
        hot=hot["target"], how="left",
    )
    return full.select(F.col("_source_id").alias("source"), F.col("_target_id").alias("target"))


def union_tagged(tables: dict[str, DataFrame], column: str = "mode") -> DataFrame:
    """Stack tables, each tagged with its own name."""
    stacked = None
    for name, table in tables.items():
        tagged = table.withColumn(column, F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return stacked
