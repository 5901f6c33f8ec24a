"""Learning classes from the graph with ``pyspark.ml``.

Follows Simplified Graph Convolution (Wu et al., 2019): propagate the features a
few hops over the whole graph, then fit a linear classifier on the train nodes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import as_array, as_ml_vector
from ..session import drop_finished, settle, settle_by
from .fusion import FUSIONS
from .graph import Graph
from .layers import gcn_propagate, with_norms
from .metrics import classify, metrics_report, nll

#: Bytes of the messages of one hop up to which wide vectors go whole; beyond it, so many of
#: their entries take all hops before the next ones do.
WHOLE_BYTES = 1 << 28
SLICE = 64
#: Seconds that the last slice's shuffle files get to go in, before the slices are stored a second time.
CLEANING_S = 1.5


@dataclass(frozen=True)
class Trained:
    model: LogisticRegressionModel
    predictions: DataFrame
    #: ``(node_id, label, mode, features)``: what was learnt from and predicted.
    rows: DataFrame
    reg: float


def smooth(
    graph: Graph, vectors: DataFrame, hops: int, *, width: int | None = None, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """The features after ``hops`` rounds of normalised propagation.

    Wide vectors of a known ``width`` go in slices where there are many links, since a hop
    keeps a message per link on disk.
    """
    rows = with_norms(graph, vectors)
    if hops and width is not None and width > SLICE and 8 * width * graph.hops.count() > whole_bytes:
        return _smooth_slices(graph, rows, hops, width)
    for _ in range(hops):
        rows = gcn_propagate(graph, rows)
    return rows.select("node_id", "vec")


def _smooth_slices(graph: Graph, rows: DataFrame, hops: int, width: int) -> DataFrame:
    """All hops for ``SLICE`` entries after the other, so that only one slice's messages are on disk.

    Links, senders and results are stored by node, and put together without a shuffle.
    """
    spark = rows.sparkSession
    rows = settle_by(rows, "node_id")
    graph = replace(graph, hops=settle_by(graph.proper_hops, "src"))
    done = None
    for first in range(0, width, SLICE):
        drop_finished(spark)
        size, name = min(SLICE, width - first), f"_{first}"
        part = rows.select("node_id", F.slice(as_array(rows), first + 1, size).alias("vec"), "norm")
        for _ in range(hops):
            part = gcn_propagate(graph, part, width=size, most=SLICE)
        part = settle_by(part.select("node_id", F.col("vec").alias(name)), "node_id")
        done = part if done is None else done.join(part, "node_id")
    del rows, graph, part  # the slices hold what is still needed
    drop_finished(spark, wait=CLEANING_S)
    return done.select("node_id", F.concat(*[f"_{first}" for first in range(0, width, SLICE)]).alias("vec"))


def fit_and_predict(
    nodes: DataFrame,
    vectors: DataFrame,
    *,
    max_iter: int = 50,
    reg: float = 0.001,
    tol: float = 1e-6,
    standardize: bool = True,
) -> Trained:
    """Fit on train rows, predict all rows.

    ``nodes`` is ``(node_id, label, mode)``. The joined rows are stored once: the
    optimiser reads them in every iteration.
    """
    rows = settle(
        nodes.select("node_id", "label", "mode").join(
            vectors.select("node_id", as_ml_vector(vectors).alias("features")), "node_id"
        )
    )
    del vectors
    drop_finished(rows.sparkSession)
    learner = LogisticRegression(
        featuresCol="features", labelCol="label", family="multinomial", maxIter=max_iter,
        regParam=reg, tol=tol, standardization=standardize,
    )
    model = learner.fit(rows.filter(F.col("mode") == "train"))
    scored = model.transform(rows).select(
        "node_id", "label", "mode", vector_to_array("rawPrediction").alias("scores")
    )
    predictions = classify(scored).withColumn(
        "loss", nll(V.log_softmax(F.col("scores")), F.col("label"))
    ).withColumn("scores", F.transform(V.log_softmax(F.col("scores")), F.exp))
    return Trained(model, predictions, rows, reg)


def learnt_map(model: LogisticRegressionModel) -> V.Linear:
    return V.Linear(model.coefficientMatrix.toArray(), model.interceptVector.toArray())


def largest_gradient(done: Trained) -> float:
    """The largest entry of the gradient of the regularised loss at the learnt weights.

    It is zero only at the optimum. Only for models fitted without standardising. The sums
    have one cell per weight; the rows are summed in Spark.
    """
    layer = learnt_map(done.model)
    train = done.rows.filter(F.col("mode") == "train").withColumn("_x", V.as_array(done.rows, "features"))
    wrong = F.zip_with(
        F.transform(V.log_softmax(V.linear(F.col("_x"), layer)), F.exp),
        V.one_hot(F.col("label"), layer.n_out), lambda p, y: p - y,
    )
    # the bias is the weight of an entry that is always 1
    entries = F.concat(F.col("_x"), F.array(F.lit(1.0)))
    sums = (
        train.select(entries.alias("_x"), wrong.alias("_r"))
        .select(F.posexplode("_x").alias("dim", "x"), "_r").filter(F.col("x") != 0)
        .groupBy("dim").agg(*[F.sum(F.col("x") * F.col("_r")[k]).alias(f"c{k}") for k in range(layer.n_out)])
    ).collect()
    weights = np.append(layer.weight, np.zeros((layer.n_out, 1)), axis=1) * done.reg
    gradient, count = weights, train.count()
    for row in sums:
        gradient[:, row["dim"]] += np.array(row[1:]) / count
    return float(np.abs(gradient).max())


def training_report(done: Trained, *, bound: float = 1e-4) -> DataFrame:
    """Per split: rows, whether predictions follow the learnt map, whether it is optimal."""
    scores = V.linear(V.as_array(done.rows, "features"), learnt_map(done.model))
    return (
        done.rows.select("node_id", "mode", V.argmax(scores).alias("_best"))
        .join(done.predictions.select("node_id", "pred"), "node_id")
        .groupBy("mode").agg(F.count("*").alias("n"), F.every(F.col("_best") == F.col("pred")).alias("agrees"))
        .withColumn("optimal", F.lit(largest_gradient(done) < bound))
    )


def train_node_classifier(
    graph: Graph, nodes: DataFrame, vectors: DataFrame, *, hops: int = 2, width: int | None = None, **options
) -> Trained:
    """Train nodes teach; every node is predicted, with the whole graph in view."""
    return fit_and_predict(nodes, smooth(graph, vectors, hops, width=width), **options)


def train_fused_classifier(
    graph: Graph,
    nodes: DataFrame,
    text_vectors: DataFrame,
    *,
    fusion: str = "sum",
    hops: int = 2,
    **options,
) -> Trained:
    """The same over merged text and node vectors (concat, sum or compose)."""
    if fusion not in FUSIONS:
        raise ValueError(f"unknown fusion {fusion!r}: expected one of {sorted(FUSIONS)}")
    around = smooth(graph, text_vectors, hops)
    return fit_and_predict(nodes, FUSIONS[fusion](around, text_vectors), **options)


def evaluate_splits(predictions: DataFrame) -> DataFrame:
    """One metrics row per split of ``(label, pred, mode, loss)``."""
    return metrics_report(predictions)
