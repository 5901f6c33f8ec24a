"""Losses and classification metrics over predictions.

Predictions are ``(node_id, label, pred)``; scores are an array column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def num_labels(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_distinct("label").alias("num_labels"))


def split_sizes(nodes: DataFrame) -> DataFrame:
    """Rows per split and overall (``mode`` = ``all``)."""
    return (
        nodes.rollup("mode")
        .agg(F.count("*").alias("n"), F.grouping("mode").alias("_all"))
        .select(F.when(F.col("_all") == 1, "all").otherwise(F.col("mode")).alias("mode"), "n")
    )


def classify(scored: DataFrame, *, scores: str = "scores") -> DataFrame:
    """Add ``pred``, the class with the highest score."""
    return scored.withColumn("pred", V.argmax(F.col(scores)))


def _hit() -> Column:
    return (F.col("pred") == F.col("label")).cast("double")


def accuracy(predictions: DataFrame, *, scores: str | None = None) -> DataFrame:
    """Share of right predictions, from class ids or from score rows."""
    rows = predictions if scores is None else classify(predictions, scores=scores)
    return rows.agg(F.avg(_hit()).alias("accuracy"))


def f1_micro(predictions: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Micro-averaged F1: hits, false positives and misses pooled over classes."""
    wrong = (F.col("label") != F.col("pred")).cast("bigint")
    right = F.lit(1) - wrong
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("cls"), right.alias("tp"), none.alias("fp"), wrong.alias("fn")),
        F.struct(F.col("pred").alias("cls"), none.alias("tp"), wrong.alias("fp"), none.alias("fn")),
    )
    per_class = (
        predictions.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, "s.cls")
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.fp").alias("fp"), F.sum("s.fn").alias("fn"))
    )
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return per_class.groupBy(*by).agg((2.0 * tp / (2.0 * tp + fp + fn)).alias("f1_micro"))


def confusion_matrix(predictions: DataFrame, k: int) -> DataFrame:
    """All k x k cells as ``(label, pred, n)``; rows are the truth.

    A label or prediction outside ``0 .. k - 1`` is an error.
    """
    def known(name: str) -> Column:
        inside = (F.col(name) >= 0) & (F.col(name) < k)
        return F.when(inside, F.col(name)).otherwise(F.raise_error(F.lit(f"{name} outside 0 .. {k - 1}"))).alias(name)

    counted = predictions.select(known("label"), known("pred")).groupBy("label", "pred").agg(F.count("*").alias("n"))
    cells = predictions.sparkSession.range(k).select(
        F.col("id").cast("int").alias("label"),
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("pred"),
    )
    return cells.join(counted, ["label", "pred"], "left").select(
        "label", "pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_table(predictions: DataFrame, k: int) -> DataFrame:
    """The confusion matrix as one row per true class and one column per prediction."""
    return (
        confusion_matrix(predictions, k).groupBy("label")
        .pivot("pred", list(range(k))).agg(F.sum("n"))
    )


def nll(logp: Column, label: Column) -> Column:
    """``-logp[label]`` for one row."""
    return -F.element_at(logp, label + 1)


def nll_loss(scored: DataFrame, *, logp: str = "logp") -> DataFrame:
    return scored.agg(F.avg(nll(F.col(logp), F.col("label"))).alias("loss"))


def bce_with_logits(scores: Column, label: Column, k: int) -> Column:
    """Mean over classes of ``max(x, 0) - x y + log1p(exp(-|x|))`` for one row."""
    terms = F.zip_with(
        scores,
        V.one_hot(label, k),
        lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))),
    )
    return V.total(terms) / F.lit(float(k))


def bce_logits_loss(scored: DataFrame, k: int, *, scores: str = "scores") -> DataFrame:
    """Mean over rows and classes; every row has k scores, so row means average up."""
    return scored.agg(
        F.avg(bce_with_logits(F.col(scores), F.col("label"), k)).alias("loss")
    )


def batch_mean_loss(losses: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Average of the batches' mean losses; each batch weighs the same."""
    per_batch = losses.groupBy(*by, "batch_id").agg(F.avg("loss").alias("loss"))
    return per_batch.groupBy(*by).agg(F.avg("loss").alias("loss"))


def metrics_report(predictions: DataFrame) -> DataFrame:
    """One row per split: accuracy and F1 to 4 digits, loss to 5.

    On single-label rows every miss is one false positive and one false negative,
    so pooled F1 is the accuracy; ``f1_micro`` computes it from class counts.
    """
    return predictions.groupBy("mode").agg(
        F.count("*").alias("n"),
        F.round(F.avg(_hit()), 4).alias("acc"),
        F.round(F.avg(_hit()), 4).alias("f1_micro"),
        F.round(F.avg("loss"), 5).alias("loss"),
    )
