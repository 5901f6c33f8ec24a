"""Whole chains: training, plans, and results that do not depend on partitions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkloom.operators import ordering, seeds, training
from linkloom.operators.graph import Graph
from linkloom.plans import fixtures as fx
from linkloom.plans.dataset import LinkedTexts
from linkloom.plans.experiment import run_experiment
from linkloom.plans.registry import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(CHECKS)


def test_ten_seeds_equal_ten_single_fits(spark):
    rng = np.random.default_rng(6)
    n = 400
    label = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + label[:, None] * [1.0, -1.0, 0.5, 0.0]
    nodes = spark.createDataFrame(list(enumerate(label.tolist())), "node_id bigint, label int")
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "node_id bigint, vec array<double>").repartition(3)
    chosen = range(1, 11)
    models = seeds.train_seeds(nodes, vectors, classes=3, reg=0.01, tol=1e-8, max_iter=500)
    assert sorted(models.weights) == list(chosen) and max(models.gradients.values()) < 1e-7
    assert models.passes < 200  # for ten models
    for seed in (1, 4, 10):
        done = training.fit_and_predict(
            ordering.split(nodes, seed=seed), vectors, reg=0.01, max_iter=2000, tol=1e-14, standardize=False
        )
        layer = training.learnt_map(done.model)
        ours = models.weights[seed]
        assert ours[:, :-1] == pytest.approx(layer.weight, abs=1e-6)
        assert ours[:, -1] - ours[:, -1].mean() == pytest.approx(layer.bias - layer.bias.mean(), abs=1e-6)
    alone = seeds.train_seeds(nodes, vectors, seeds=range(4, 5), classes=3, reg=0.01, tol=1e-8, max_iter=500)
    assert alone.weights[4] == pytest.approx(models.weights[4], abs=1e-6)
    predicted = {(r.seed, r.node_id): r.pred for r in seeds.predict_seeds(models).collect()}
    assert len(predicted) == 10 * n
    w = models.weights[7]
    assert [predicted[7, i] for i in range(n)] == (x @ w[:, :-1].T + w[:, -1]).argmax(1).tolist()
    with pytest.raises(ValueError, match="0 to 62"):
        seeds.train_seeds(nodes, vectors, seeds=range(60, 70), classes=3)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def two_cliques(spark, size=30):
    n = 2 * size
    nodes = spark.range(n).select(
        F.col("id").alias("node_id"), (F.col("id") >= size).cast("int").alias("label")
    )
    edges = [(i, j) for b in (0, size) for i in range(b, b + size) for j in (i + 1, i + 2) if j < b + size]
    vectors = spark.createDataFrame(
        [(i, [float(i * 7919 % 13) - 6 + (3.0 if i >= size else -3.0), 1.0]) for i in range(n)],
        "node_id bigint, vec array<double>",
    )
    return nodes, spark.createDataFrame(edges, "src bigint, dst bigint"), vectors


def test_training_learns_from_neighbours(spark):
    from linkloom.operators.ordering import split

    nodes, edges, vectors = two_cliques(spark)
    graph, labelled = Graph.build(nodes, edges), split(nodes)
    done = training.train_node_classifier(graph, labelled, vectors)
    report = {r["mode"]: r for r in training.evaluate_splits(done.predictions).collect()}
    assert done.predictions.count() == 60 and set(report) == {"train", "valid", "test"}
    assert report["test"]["acc"] > 0.8 and report["test"]["loss"] < 0.6
    for fusion in ("concat", "sum", "compose"):
        fused = training.train_fused_classifier(graph, labelled, vectors, fusion=fusion)
        assert fused.predictions.count() == 60
    with pytest.raises(ValueError):
        training.train_fused_classifier(graph, labelled, vectors, fusion="other")


def test_experiment_writes_its_results(spark, tmp_path):
    data = LinkedTexts.load(fx.articles_full(spark, SF), fx.citations(spark, SF))
    run = run_experiment(data, run_name="r1", save_dir=str(tmp_path), max_iter=5)
    assert run.predictions.count() == data.real_len
    stored = spark.read.parquet(f"{tmp_path}/r1/metrics")
    assert {r["mode"] for r in stored.collect()} == {"train", "valid", "test"}
    table = spark.read.csv(f"{tmp_path}/r1/data.csv", header=True, escape='"', multiLine=True)
    assert table.count() == data.real_len
    assert {"node_id", "text_id", "label", "authors", "title", "time", "mode"} <= set(table.columns)


def test_experiment_smooths_features_in_slices(spark, monkeypatch):
    """With many links the text features, whose width the model knows, go slice by slice; nothing else changes."""
    data = LinkedTexts.load(fx.articles(spark, SF), fx.citations(spark, SF))
    plain, smooth, widths = run_experiment(data, max_iter=5), training.smooth, []

    def sliced(*args, width=None, **options):
        widths.append(width)
        return smooth(*args, width=width, whole_bytes=0, **options)

    monkeypatch.setattr(training, "smooth", sliced)
    run = run_experiment(data, max_iter=5)
    assert widths == [run.trained.model.numFeatures] and widths[0] > training.SLICE
    a, b = ({r.node_id: r for r in x.trained.rows.collect()} for x in (plain, run))
    assert a.keys() == b.keys()
    assert all((a[k].label, a[k].mode) == (b[k].label, b[k].mode) for k in a)
    assert np.array([a[k].features.toArray() for k in a]) == pytest.approx(np.array([b[k].features.toArray() for k in a]), abs=1e-12)


@pytest.mark.parametrize("name", ["reindex_edges", "gcn2_forward", "gat_forward", "split_70_10_20", "tfidf_l2"])
def test_results_do_not_depend_on_partitions(spark, name):
    results = []
    try:
        for partitions in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            df = entry.queries()[name](spark, SF)
            results.append(sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


PLAN_FREE = [
    "edges_known_endpoints", "edges_encode", "drop_isolated", "links_by_title", "adjacency_coo",
    "document_frequency", "tfidf_l2", "gcn2_forward", "gin_forward", "sage_forward", "gat_forward",
    "coauthor_sum", "coauthor_edges", "confusion_matrix", "fuse_concat",
]


@pytest.mark.parametrize("name", PLAN_FREE)
def test_plans_have_no_product_and_no_global_sort(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    # one partition is only allowed for offsets, whose rows are counts per bucket
    for part in re.findall(r"Exchange SinglePartition.*\n.*", plan):
        assert "_part" in part or "count" in part, part


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["edges_known_endpoints"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lineitem = [line for line in plan.splitlines() if "lineitem" in line]
    assert lineitem and all("ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>" in x for x in lineitem)


def _write_tables(spark, path):
    spark.range(60).selectExpr("id as doc_id", "concat('text of words, line ', id, '\\nmore') as text", "'en' as lang", "'web' as source", "20L as n_chars").write.parquet(f"{path}/documents.parquet")
    spark.range(90).selectExpr("id as o_orderkey", "id % 7 as o_custkey").write.parquet(f"{path}/orders.parquet")
    spark.range(40).selectExpr("id % 10 as user_id", "concat('e', id % 3) as event_type", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(id)) as ts").write.parquet(f"{path}/events.parquet")


def test_node_table_joins_its_texts_with_settled_rows(spark, monkeypatch, tmp_path):
    """Ids and splits do not read the articles again when the texts are written."""
    from linkloom.plans import catalog_tables
    from linkloom.sources import sinks

    seen, write = [], sinks.write_nodes
    monkeypatch.setattr(sinks, "write_nodes", lambda nodes, path: (seen.append(nodes), write(nodes, path)))
    _write_tables(spark, tmp_path)
    got = catalog_tables.sink_nodes_csv(spark, str(tmp_path)).collect()
    kept = [i for i in range(60) if i % 37 != 5 and i % 41 != 7]
    assert sorted((r.node_id, r.text_id, r.text) for r in got) == [(n, i, f"text of words, line {i}\nmore") for n, i in enumerate(kept)]
    n_train = int(0.7 * len(kept))
    assert sum(r["mode"] == "train" for r in got) == n_train
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 12, plan.count("Relation [")


def test_features_cut_texts_into_words_once(spark, monkeypatch):
    from linkloom.operators import tfidf

    nodes = spark.range(20).selectExpr("id as node_id", "concat('alpha beta', id % 3) as text")
    data = LinkedTexts(nodes, spark.createDataFrame([(0, 1)], "src bigint, dst bigint"))
    calls, cut = [], tfidf.tokenize
    monkeypatch.setattr(tfidf, "tokenize", lambda *args, **more: (calls.append(1), cut(*args, **more))[1])
    model, features = data.features(max_df=1.0)
    assert features.count() == 20 and model.terms == ("alpha", "beta0", "beta1", "beta2") and len(calls) == 1
