"""The whole chain of one run: data, features, training, metrics, results on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import training
from ..sources import sinks
from .dataset import LinkedTexts


@dataclass(frozen=True)
class Run:
    predictions: DataFrame
    metrics: DataFrame
    trained: training.Trained


def run_experiment(
    data: LinkedTexts,
    *,
    text_vectors: DataFrame | None = None,
    fusion: str | None = None,
    hops: int = 2,
    run_name: str = "test",
    save_dir: str | None = None,
    **options,
) -> Run:
    """Train on the train split and score every split.

    Without ``fusion`` the features are TF-IDF vectors smoothed over the graph.
    With ``fusion`` (concat, sum, compose) stored text vectors are merged with
    their smoothed form. ``save_dir`` receives the node table and the metrics.
    """
    graph = data.create_graph()
    nodes = data.nodes.select("node_id", "label", "mode")
    if fusion is None:
        model, features = data.features()
        done = training.train_node_classifier(graph, nodes, features, hops=hops, width=len(model.terms), **options)
    else:
        if text_vectors is None:
            raise ValueError("a fusion model needs text_vectors(node_id, vec)")
        done = training.train_fused_classifier(
            graph, nodes, text_vectors, fusion=fusion, hops=hops, **options
        )
    metrics = training.evaluate_splits(done.predictions).withColumn("run", F.lit(run_name))
    if save_dir:
        base = f"{save_dir.rstrip('/')}/{run_name}"
        sinks.write_nodes(data.nodes, f"{base}/data.csv")
        sinks.write_metrics(metrics, f"{base}/metrics")
        done.model.write().overwrite().save(f"{base}/model")
    return Run(done.predictions, metrics, done)
