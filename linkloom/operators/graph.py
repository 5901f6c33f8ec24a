"""Graph tables: undirected edges, adjacency, degrees and edge weights.

Edges come in as ``(src, dst)`` in node ids. The graph is undirected and simple;
a self-loop is allowed and sits once on the diagonal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .joins import HotKeys, hot_keys, lookup_join
from .propagate import neighbour_sum



def undirected_edges(edges: DataFrame, *, merge: str = "max") -> DataFrame:
    """Unordered distinct pairs ``(u, v)`` with ``u <= v``, and their ``weight`` if edges have one.

    Weights of both directions and of repeats are merged: ``max`` keeps one link's
    weight, so that weights of 1 are a graph without weights; ``sum`` adds up, as for
    numbers of references. A link whose weight is null or not positive is none.
    """
    pair = [F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")]
    if "weight" not in edges.columns:
        return edges.select(*pair).distinct()
    if merge not in ("max", "sum"):
        raise ValueError(f"unknown merge {merge!r}: expected 'max' or 'sum'")
    merged = F.max("weight") if merge == "max" else F.sum("weight")
    known = edges.filter(F.col("weight") > 0).select(*pair, F.col("weight").cast("double").alias("weight"))
    return known.groupBy("u", "v").agg(merged.alias("weight"))


def adjacency(edges: DataFrame, *, merge: str = "max") -> DataFrame:
    """Symmetric adjacency ``(row, col, value)``, value 1 or the merged weight.

    Pairs are made distinct before they are mirrored, so each is shuffled once.
    """
    pairs = undirected_edges(edges, merge=merge)
    there = F.struct(F.col("u").alias("row"), F.col("v").alias("col"))
    back = F.struct(F.col("v").alias("row"), F.col("u").alias("col"))
    both = F.when(F.col("u") == F.col("v"), F.array(there)).otherwise(F.array(there, back))
    value = F.col("weight") if "weight" in pairs.columns else F.lit(1.0)
    return (
        pairs.select(F.explode(both).alias("cell"), value.alias("value"))
        .select("cell.row", "cell.col", "value")
    )


def edge_index(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` of all non-zeros, both directions."""
    return adjacency(edges).select(F.col("row").alias("src"), F.col("col").alias("dst"))


@dataclass(frozen=True)
class Graph:
    """A graph prepared for message passing.

    ``hops(src, dst, own)`` holds both directions of every edge and one ``own``
    row per node, so a single join and aggregate gives a node its neighbours and
    itself, and isolated nodes need no extra join. ``hot`` lists the hub nodes
    whose rows are spread over many tasks. On a ``weighted`` graph every row has a
    ``weight``; that of an own row is the node's loop, or 1 without one.
    """

    nodes: DataFrame
    hops: DataFrame
    hot: HotKeys
    weighted: bool = False

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, *, keep: bool = True, merge: str = "max") -> "Graph":
        """Prepare a graph; ``keep`` stores the hop table once for all layers.

        Edges with a ``weight`` give a weighted graph; ``merge`` as in ``undirected_edges``.
        """
        own = nodes.select(
            F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(True).alias("own")
        )
        weighted = "weight" in edges.columns
        if weighted:
            cells = adjacency(edges, merge=merge)
            loops = cells.filter(F.col("row") == F.col("col")).select(F.col("row").alias("_loop"), "value")
            own = own.join(loops, F.col("src") == F.col("_loop"), "left").select(
                "src", "dst", "own", F.coalesce("value", F.lit(1.0)).alias("weight")
            )
            links = cells.select(F.col("row").alias("src"), F.col("col").alias("dst"), F.lit(False).alias("own"), F.col("value").alias("weight"))
        else:
            links = edge_index(edges).withColumn("own", F.lit(False))
        hops = links.unionByName(own)
        if keep:
            hops = settle(hops)
        return cls(nodes.select("node_id"), hops, hot_keys(hops, "src")["src"], weighted)

    @property
    def proper_hops(self) -> DataFrame:
        """Own rows and edges between different nodes: one loop per node."""
        return self.hops.filter(F.col("own") | (F.col("src") != F.col("dst")))

    @property
    def all_hops(self) -> DataFrame:
        """Own rows and every edge, a self-cited node's loop included; own rows weigh 1."""
        if not self.weighted:
            return self.hops
        return self.hops.withColumn("weight", F.when(F.col("own"), 1.0).otherwise(F.col("weight")))


def degrees(graph: Graph) -> DataFrame:
    """Neighbours per node, and the degree with exactly one loop added."""
    edge = ~F.col("own")
    proper = F.col("own") | (F.col("src") != F.col("dst"))
    return graph.hops.groupBy(F.col("dst").alias("node_id")).agg(
        F.sum(edge.cast("bigint")).alias("degree"),
        F.sum(proper.cast("bigint")).alias("loop_degree"),
    )


def norms(graph: Graph) -> DataFrame:
    """``(node_id, norm)`` with ``norm = 1/sqrt(degree with loop)``, or of the sum of weights."""
    if graph.weighted:
        totals = graph.proper_hops.groupBy(F.col("dst").alias("node_id")).agg(F.sum("weight").alias("_total"))
    else:
        totals = degrees(graph).select("node_id", F.col("loop_degree").cast("double").alias("_total"))
    return totals.select("node_id", (F.lit(1.0) / F.sqrt("_total")).alias("norm"))


def gcn_edge_weights(graph: Graph) -> DataFrame:
    """``w_ij/sqrt(d_i d_j)`` over edges plus one loop per node."""
    scale = norms(graph)
    left = scale.toDF("_src", "_src_norm")
    right = scale.toDF("_dst", "_dst_norm")
    half = lookup_join(graph.proper_hops.drop("own"), left, "src", "_src", hot=graph.hot).drop("_src")
    full = lookup_join(half, right, "dst", "_dst", hot=graph.hot)
    scaled = F.col("_src_norm") * F.col("_dst_norm")
    return full.select("src", "dst", (scaled * F.col("weight") if graph.weighted else scaled).alias("weight"))


def reference_weights(edges: DataFrame) -> DataFrame:
    """Weight of a link = number of references from one document to the other."""
    return edges.groupBy("source", "target").agg(F.count("*").alias("weight"))


def coauthor_edges(edges: DataFrame, doc_authors: DataFrame) -> DataFrame:
    """Linked documents that share authors; weight = number of shared authors.

    Checks the given pairs only. All pairs of an author's documents are never
    listed: that is quadratic in a prolific author. ``coauthor_sum`` walks the
    whole co-author graph through the authors instead.
    """
    pairs = edges.select("src", "dst")
    mine = doc_authors.select(F.col("node_id").alias("_mine"), "author")
    theirs = doc_authors.select(F.col("node_id").alias("dst"), "author")
    # spread the side in which a document is heavy: its authors, or else its links
    crowded = hot_keys(mine, "_mine")["_mine"]
    if crowded:
        candidates = lookup_join(mine, pairs, "_mine", "src", hot=crowded)
    else:
        candidates = lookup_join(pairs, mine, "src", "_mine", hot=hot_keys(pairs, "src")["src"])
    return (
        candidates.join(theirs, ["dst", "author"])
        .groupBy("src", "dst")
        .agg(F.count("*").alias("weight"))
    )


def coauthor_degree(doc_authors: DataFrame) -> DataFrame:
    """Weighted co-author degree: for each author, their other documents."""
    hot = hot_keys(doc_authors, "author")["author"]
    sizes = doc_authors.groupBy(F.col("author").alias("_author")).agg(
        F.count("*").alias("_size")
    )
    return (
        lookup_join(doc_authors, sizes, "author", "_author", hot=hot)
        .groupBy("node_id")
        .agg(F.sum(F.col("_size") - 1).alias("degree"))
    )


def coauthor_sum(doc_authors: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sum of co-author neighbours' vectors, each weighted by shared authors.

    The co-author graph is the product of the document-author table with its own
    transpose. Going documents -> authors -> documents gives the same sums with
    one row per (document, author) and no row per pair of documents.
    """
    hot = hot_keys(doc_authors, "author", "node_id")
    own = vectors.select(F.col("node_id").alias("_doc"), "vec")
    written = lookup_join(doc_authors, own, "node_id", "_doc", hot=hot["node_id"])
    per_author = neighbour_sum(written.drop("node_id", "_doc"), by="author").select(
        F.col("author").alias("_author"), F.col("vec").alias("_sum")
    )
    back = lookup_join(
        written.drop("_doc"), per_author, "author", "_author", hot=hot["author"]
    ).select("node_id", F.zip_with("_sum", "vec", lambda s, x: s - x).alias("vec"))
    return neighbour_sum(back, by="node_id")
