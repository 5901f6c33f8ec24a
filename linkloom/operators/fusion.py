"""Text vectors and node vectors: fetch, refresh, merge, classify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import as_array
from .graph import Graph
from .layers import gcn2_forward


def gather_rows(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors of the listed ids."""
    return vectors.join(ids.select("node_id"), "node_id")


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Overwrite the vectors of the ids in ``new``, keep the rest."""
    fresh = new.select("node_id", F.col("vec").alias("_new"))
    return old.join(fresh, "node_id", "left").select(
        "node_id", F.coalesce("_new", "vec").alias("vec")
    )


def fill_text_vectors(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Every document with its stored text vector, over all splits."""
    return nodes.join(stored.select("node_id", as_array(stored).alias("vec")), "node_id")


def node_vectors(graph: Graph, text_vectors: DataFrame, layers) -> DataFrame:
    """``N``: the two-layer convolution with classifier head over text vectors.

    The fusion models read its log-softmax output, not the hidden state.
    """
    return gcn2_forward(graph, text_vectors, layers)


def _paired(n: DataFrame, t: DataFrame) -> DataFrame:
    text = t.select("node_id", as_array(t).alias("_t"))
    return n.join(text, "node_id")


def fuse_concat(n: DataFrame, t: DataFrame) -> DataFrame:
    """Late fusion: node vector, then text vector."""
    return _paired(n, t).select("node_id", F.concat("vec", "_t").alias("vec"))


def fuse_sum(n: DataFrame, t: DataFrame) -> DataFrame:
    """Element-wise sum; both vectors have the same width."""
    return _paired(n, t).select("node_id", V.add(F.col("vec"), F.col("_t")).alias("vec"))


def fuse_compose(n: DataFrame, t: DataFrame | None = None) -> DataFrame:
    """Compositional: the node vector alone."""
    return n.select("node_id", "vec")


FUSIONS = {"concat": fuse_concat, "sum": fuse_sum, "compose": fuse_compose}


def classifier_head(vectors: DataFrame, layer: V.Linear) -> DataFrame:
    """``(node_id, scores, pred)``."""
    scored = vectors.select("node_id", V.linear(as_array(vectors), layer).alias("scores"))
    return scored.withColumn("pred", V.argmax(F.col("scores")))
