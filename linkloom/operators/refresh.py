"""Node vectors after a batch of text vectors changed, without the rest of the graph.

A layer's result at a node depends on the node and its neighbours alone. A changed batch
therefore changes the hidden vectors of the batch and its neighbours, and the results of
those and theirs: a frontier that grows by one hop per layer. Only rows that lead to the
frontier are joined and summed; degrees are those of the whole graph and are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import as_array
from ..session import settle
from .graph import Graph, norms
from .layers import gcn_layer, map_vectors


@dataclass(frozen=True)
class NodeState:
    """Text vectors, hidden vectors and results ``(node_id, vec)`` of a two-layer convolution."""

    norms: DataFrame
    text: DataFrame
    hidden: DataFrame
    nodes: DataFrame


def _hidden(graph: Graph, text: DataFrame, layers) -> DataFrame:
    return map_vectors(gcn_layer(graph, text, layers[0]), V.relu)


def _result(graph: Graph, hidden: DataFrame, layers) -> DataFrame:
    state = map_vectors(gcn_layer(graph, hidden, layers[1]), V.relu)
    return map_vectors(state, lambda v: V.log_softmax(V.linear(v, layers[2])))


def node_state(graph: Graph, text_vectors: DataFrame, layers) -> NodeState:
    """All node vectors, with what ``refresh_node_vectors`` needs; each part is stored."""
    scale = settle(norms(graph))
    text = settle(text_vectors.select("node_id", as_array(text_vectors).alias("vec")))
    hidden = settle(_hidden(graph, text.join(scale, "node_id"), layers).select("node_id", "vec"))
    result = _result(graph, hidden.join(scale, "node_id"), layers).select("node_id", "vec")
    return NodeState(scale, text, hidden, settle(result))


def frontier(graph: Graph, ids: DataFrame) -> DataFrame:
    """``ids`` and their neighbours; own rows lead from a node to itself."""
    reached = graph.proper_hops.join(ids.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi")
    return reached.select(F.col("dst").alias("node_id")).distinct()


def part_of(graph: Graph, ids: DataFrame) -> Graph:
    """The graph with only the rows that lead to ``ids``."""
    leading = graph.hops.join(ids.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return replace(graph, nodes=ids, hops=leading.select(graph.hops.columns))


def _senders(part: Graph, vectors: DataFrame, scale: DataFrame) -> DataFrame:
    """What the rows of a part read: its senders' vectors and norms."""
    needed = part.hops.select(F.col("src").alias("node_id")).distinct()
    return vectors.join(needed, "node_id", "left_semi").join(scale.join(needed, "node_id", "left_semi"), "node_id")


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    kept = old.join(new.select("node_id"), "node_id", "left_anti")
    return kept.select("node_id", "vec").unionByName(new.select("node_id", "vec"))


def refresh_node_vectors(graph: Graph, state: NodeState, batch: DataFrame, layers) -> NodeState:
    """The state after the vectors of ``batch`` (``node_id, vec``) replaced those of their nodes.

    Equal to ``node_state`` over the changed vectors. The hop table and the old vectors
    are filtered by the frontier (it is as large as the batch and its neighbours, so AQE
    may broadcast it); rows outside it are neither joined, summed nor mapped. Ids that
    are no nodes are left out; of an id given twice one vector is taken.
    """
    known = state.text.select("node_id")
    fresh = settle(
        batch.select("node_id", as_array(batch).alias("vec")).dropDuplicates(["node_id"]).join(known, "node_id", "left_semi")
    )
    text = settle(_replaced(state.text, fresh))
    first = settle(frontier(graph, fresh))
    near = part_of(graph, first)
    hidden_part = settle(_hidden(near, _senders(near, text, state.norms), layers).select("node_id", "vec"))
    hidden = settle(_replaced(state.hidden, hidden_part))
    far = part_of(graph, settle(frontier(graph, first)))
    result = settle(_result(far, _senders(far, hidden, state.norms), layers).select("node_id", "vec"))
    return NodeState(state.norms, text, hidden, settle(_replaced(state.nodes, result)))
