"""Graph layers and models as DataFrame queries over given weights.

Vectors are ``(node_id, vec)``. A layer is one join with the hop table and one
aggregate. A linear map commutes with the sum over neighbours, so it runs on
whichever side of the shuffle has the narrower vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import as_array
from ..session import settle
from .graph import Graph, norms
from .joins import lookup_join
from .propagate import BLOCK, hop
from .softmax import softmax_sums

#: Fixed value: slope of the attention score below zero.
LEAKY_SLOPE = 0.2


def map_vectors(vectors: DataFrame, function) -> DataFrame:
    """Apply a column function to every vector, row by row, without a shuffle."""
    return vectors.withColumn("vec", function(F.col("vec")))


def with_norms(graph: Graph, vectors: DataFrame) -> DataFrame:
    return vectors.select("node_id", "vec").join(norms(graph), "node_id")


def gcn_propagate(graph: Graph, vectors: DataFrame, *, width: int | None = None, most: int = BLOCK) -> DataFrame:
    """``sum_j w_ij x_j / sqrt(d_i d_j)`` over neighbours j and i itself.

    The degree's part factors into a part of the sender and one of the receiver, so
    edges carry their own weight at most: the sum weighs each sender, and one scaling
    per node follows. Keeps a ``norm`` column if the input has one, for the next layer.
    """
    chained = "norm" in vectors.columns
    sent = vectors if chained else with_norms(graph, vectors)
    got = hop(graph.proper_hops, sent, hot=graph.hot, width=width, weight="norm", keep=("norm",), most=most)
    result = got.withColumn("vec", V.scale(F.col("vec"), F.col("norm")))
    return result if chained else result.drop("norm")


def gcn_layer(graph: Graph, vectors: DataFrame, layer: V.Linear) -> DataFrame:
    """``W (propagated x) + b``."""
    if layer.n_out > layer.n_in:
        propagated = gcn_propagate(graph, vectors, width=layer.n_in)
        return map_vectors(propagated, lambda v: V.linear(v, layer))
    narrowed = vectors.withColumn("vec", V.linear(as_array(vectors), layer.without_bias()))
    propagated = gcn_propagate(graph, narrowed, width=layer.n_out)
    if layer.bias is None:
        return propagated
    return map_vectors(propagated, lambda v: V.add(v, V.constant(layer.bias)))


def sage_layer(
    graph: Graph, vectors: DataFrame, neighbours: V.Linear, own: V.Linear
) -> DataFrame:
    """``l2norm(W1 sum_j w_ij x_j + b + W2 x_i)``: a sum, not a mean.

    Both maps run before the shuffle, and a node's own row sends ``W2 x + b``.
    """
    x = as_array(vectors)
    own_map = V.Linear(own.weight, neighbours.bias)
    sent = vectors.select(
        "node_id",
        V.linear(x, neighbours.without_bias()).alias("vec"),
        V.linear(x, own_map).alias("own_vec"),
    )
    summed = hop(
        graph.all_hops, sent, hot=graph.hot, own_vec="own_vec", width=neighbours.n_out
    )
    return map_vectors(summed, V.l2_normalize)


@dataclass(frozen=True)
class Mlp:
    """Linear maps with a relu between them, and after the last one if asked."""

    layers: tuple[V.Linear, ...]
    last_relu: bool = False


def gin_layer(graph: Graph, vectors: DataFrame, mlp: Mlp) -> DataFrame:
    """``MLP(x_i + sum_j w_ij x_j)``; the first map moves before the sum if it narrows."""
    first, rest = mlp.layers[0], mlp.layers[1:]
    x = as_array(vectors)
    if first.n_out <= first.n_in:
        sent = vectors.select("node_id", V.linear(x, first.without_bias()).alias("vec"))
        summed = hop(graph.all_hops, sent, hot=graph.hot, width=first.n_out)
        if first.bias is not None:
            summed = map_vectors(summed, lambda v: V.add(v, V.constant(first.bias)))
    else:
        sent = vectors.select("node_id", x.alias("vec"))
        summed = hop(graph.all_hops, sent, hot=graph.hot, width=first.n_in)
        summed = map_vectors(summed, lambda v: V.linear(v, first))
    for layer in rest:
        summed = map_vectors(summed, V.relu)
        summed = map_vectors(summed, lambda v, layer=layer: V.linear(v, layer))
    return map_vectors(summed, V.relu) if mlp.last_relu else summed


@dataclass(frozen=True)
class Attention:
    """Weights of an attention layer with ``heads`` heads of equal width.

    ``project`` maps to all heads at once (heads * width outputs, no bias);
    ``source`` and ``target`` are heads x width score vectors.
    """

    project: V.Linear
    source: np.ndarray
    target: np.ndarray
    bias: np.ndarray | None = None
    concat: bool = True

    @property
    def heads(self) -> int:
        return self.source.shape[0]

    @property
    def width(self) -> int:
        return self.source.shape[1]

    def scores(self, side: np.ndarray) -> V.Linear:
        """Scores per head as one linear map of the input vector."""
        per_head = self.project.weight.reshape(self.heads, self.width, -1)
        return V.Linear(np.einsum("hw,hwi->hi", side, per_head))


def _leaky(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(x * LEAKY_SLOPE)


def _scored(vectors: DataFrame, layer: Attention, *, wide: bool) -> DataFrame:
    x = as_array(vectors)
    columns = [
        F.col("node_id"),
        V.linear(x, layer.scores(layer.source)).alias("s"),
        V.linear(x, layer.scores(layer.target)).alias("d"),
    ]
    if wide:
        columns.append(V.linear(x, layer.project).alias("h"))
    return vectors.select(*columns)


def _edge_scores(graph: Graph, scored: DataFrame) -> DataFrame:
    """Hop rows with the target's part of the score, then the sender's part and its vector."""
    targets = scored.select(F.col("node_id").alias("_target"), "d")
    senders = scored.drop("d").withColumnRenamed("node_id", "_sender")
    aimed = lookup_join(graph.proper_hops, targets, "dst", "_target", hot=graph.hot).drop("_target")
    return lookup_join(aimed, senders, "src", "_sender", hot=graph.hot).drop("_sender", "own")


def _softmax_inputs(heads: int, wide: bool, weighted: bool):
    def score(batch, matrix):
        scores = matrix(batch.column("s")) + matrix(batch.column("d"))
        scores = np.where(scores > 0, scores, scores * LEAKY_SLOPE)
        factors = np.ones_like(scores)
        if weighted:
            factors *= batch.column("weight").to_numpy()[:, None]
        vectors = matrix(batch.column("h")) if wide else np.zeros((len(scores), 0))
        return scores, factors, vectors

    return score


def gat_attention(graph: Graph, vectors: DataFrame, layer: Attention) -> DataFrame:
    """``(src, dst, alpha)``: softmax over a target's incoming edges, per head.

    On a weighted graph an edge's mass is multiplied by its weight.
    """
    rows = _edge_scores(graph, _scored(vectors, layer, wide=False))
    weight = F.col("weight") if graph.weighted else F.lit(1.0)
    stats = softmax_sums(
        rows.withColumnRenamed("dst", "_target"), "_target", heads=layer.heads,
        score=_softmax_inputs(layer.heads, False, graph.weighted),
        finish=lambda peaks, masses, _: (peaks, masses), out=("_peak", "_mass"),
    )
    share = F.zip_with(
        F.zip_with(F.zip_with("s", "d", lambda s, d: _leaky(s + d)), "_peak", lambda e, m: F.exp(e - m)),
        "_mass", lambda p, mass: p / mass * weight,
    )
    return lookup_join(rows, stats, "dst", "_target", hot=graph.hot).select("src", "dst", share.alias("alpha"))


def gat_layer(graph: Graph, vectors: DataFrame, layer: Attention) -> DataFrame:
    """Attention-weighted sum per head; heads are joined or averaged.

    Two joins and one aggregation: peaks, masses and weighted sums are merged together
    and divided once per node. On a weighted graph an edge's mass is multiplied by its weight.
    """
    heads, width = layer.heads, layer.width

    def finish(_, masses, sums):
        shares = sums.reshape(-1, heads, width) / masses[:, :, None]
        merged = shares.reshape(-1, heads * width) if layer.concat else shares.mean(axis=1)
        return (merged if layer.bias is None else merged + layer.bias,)

    return softmax_sums(
        _edge_scores(graph, _scored(vectors, layer, wide=True)).withColumnRenamed("dst", "node_id"), "node_id",
        heads=heads, score=_softmax_inputs(heads, True, graph.weighted), finish=finish, out=("vec",),
    )


# ---------------------------------------------------------------- whole models
# Dropout is the identity when a trained model is applied.


def gcn_forward(graph: Graph, vectors: DataFrame, layers: tuple[V.Linear, V.Linear]) -> DataFrame:
    hidden = map_vectors(gcn_layer(graph, with_norms(graph, vectors), layers[0]), V.relu)
    scores = gcn_layer(graph, hidden, layers[1])
    return map_vectors(scores, V.log_softmax).drop("norm")


def gcn2_state(graph: Graph, vectors: DataFrame, layers: tuple[V.Linear, ...]) -> DataFrame:
    """Two convolutions without the classifier."""
    hidden = map_vectors(gcn_layer(graph, with_norms(graph, vectors), layers[0]), V.relu)
    return gcn_layer(graph, hidden, layers[1]).drop("norm")


def gcn2_forward(
    graph: Graph, vectors: DataFrame, layers: tuple[V.Linear, V.Linear, V.Linear]
) -> DataFrame:
    state = map_vectors(gcn2_state(graph, vectors, layers[:2]), V.relu)
    return map_vectors(state, lambda v: V.log_softmax(V.linear(v, layers[2])))


def gin_forward(graph: Graph, vectors: DataFrame, mlps: tuple[Mlp, Mlp]) -> DataFrame:
    hidden = gin_layer(graph, vectors, mlps[0])
    return map_vectors(gin_layer(graph, hidden, mlps[1]), V.log_softmax)


def gat_forward(graph: Graph, vectors: DataFrame, layers: tuple[Attention, Attention]) -> DataFrame:
    """Two attention layers. The first one's output is read several times by the
    second (scores, maxima, messages), so it is stored in between."""
    hidden = settle(map_vectors(gat_layer(graph, vectors, layers[0]), V.relu))
    return map_vectors(gat_layer(graph, hidden, layers[1]), V.log_softmax)


def sage_forward(
    graph: Graph, vectors: DataFrame, layers: tuple[tuple[V.Linear, V.Linear], ...]
) -> DataFrame:
    """Each layer is a pair (map of the neighbour sum, map of the node itself)."""
    hidden = map_vectors(sage_layer(graph, vectors, *layers[0]), V.relu)
    return map_vectors(sage_layer(graph, hidden, *layers[1]), V.log_softmax)
