"""Exact positions, splits and batches."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from linkloom.operators import ordering as O


@pytest.mark.parametrize("n", [1, 2, 90, 1001])
def test_split_is_exact_and_repeatable(spark, n):
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    got = {r.node_id: r.mode for r in O.split(nodes, seed=3).collect()}
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))
    n_train = math.floor(0.7 * n)
    n_valid = math.floor((n - n_train) * (1 / 3))
    want = {
        i: "train" if k < n_train else "valid" if k < n_train + n_valid else "test"
        for k, i in enumerate(order)
    }
    assert got == want


def test_split_does_not_depend_on_partitions(spark):
    nodes = spark.range(500).withColumnRenamed("id", "node_id")
    one = O.split(nodes.coalesce(1)).exceptAll(O.split(nodes.repartition(16)))
    assert one.isEmpty()


def test_dense_ids_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * F.col("id")).alias("ord")).repartition(7)
    got = sorted((r.ord, r.node_id) for r in O.dense_ids(rows, "ord").collect())
    assert got == [(i * i, i) for i in range(1000)]


def test_id_rank_with_gaps_and_several_buckets(spark):
    rows = spark.createDataFrame([(i * 100_000,) for i in range(20)], "node_id bigint")
    got = sorted((r.node_id, r["rank"]) for r in O.id_rank(rows).collect())
    assert got == [(i * 100_000, i) for i in range(20)]


def test_batches_are_full_and_shuffled_for_training_only(spark):
    nodes = O.split(spark.range(333).withColumnRenamed("id", "node_id"))
    batches = O.minibatches(nodes)
    sizes = {}
    for r in batches.groupBy("mode", "batch_id").count().collect():
        sizes.setdefault(r["mode"], {})[r["batch_id"]] = r["count"]
    for mode, per in sizes.items():
        n = sum(per.values())
        assert sorted(per) == list(range(math.ceil(n / 32)))
        assert all(per[b] == 32 for b in range(n // 32))
    other = O.minibatches(nodes, epoch=1).filter("mode = 'train'")
    assert not batches.filter("mode = 'train'").exceptAll(other).isEmpty()
    tests = batches.filter("mode = 'test'").orderBy("node_id").collect()
    assert [r["batch_id"] for r in tests] == sorted(r["batch_id"] for r in tests)
    assert O.batch_cap(batches, 2).count() == 64


def test_best_epochs_are_strict(spark):
    acc = {0: 0.0, 1: 0.5, 2: 0.5, 3: 0.6, 4: 0.1}
    rows = [("r", e, "valid", a) for e, a in acc.items()]
    rows += [("r", e, "test", a / 2) for e, a in acc.items()]
    metrics = spark.createDataFrame(rows, "run string, epoch int, mode string, acc double")
    assert sorted(r.epoch for r in O.best_so_far(metrics).collect()) == [1, 3]
    got = sorted((r.epoch, r.moment) for r in O.test_at_best(metrics).collect())
    assert got == [(1, "best"), (3, "best"), (4, "end")]
