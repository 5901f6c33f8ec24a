"""Articles, links, authors, histories and predictions as views of the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import Linear, linear
from ..operators.articles import without_texts
from ..operators.layers import Attention


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Raw articles with missing labels, missing texts and late duplicates."""
    docs = table(spark, sf, "documents")
    languages = F.when(F.col("lang") == "de", "0").when(F.col("lang") == "en", "1").when(
        F.col("lang") == "es", "2"
    ).otherwise("3")
    first = docs.select(
        (2 * F.col("doc_id")).alias("ord"),
        F.col("doc_id").cast("string").alias("pmid"),
        F.when(F.col("doc_id") % 37 != 5, languages).alias("label"),
        F.when(F.col("doc_id") % 41 != 7, F.col("text")).alias("abstract"),
    )
    late = docs.filter(F.col("doc_id") % 7 == 3).select(
        (2 * F.col("doc_id") + 1).alias("ord"),
        F.col("doc_id").cast("string").alias("pmid"),
        F.lit("0").alias("label"),
        F.lit("late duplicate").alias("abstract"),
    )
    return first.unionAll(late)


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Raw links with null sources and many unknown ids."""
    missing = (F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 50 == 0)
    return table(spark, sf, "lineitem").select(
        F.when(~missing, F.col("l_orderkey")).alias("source"), F.col("l_partkey").alias("target")
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of all documents."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text")


def stored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vec")
    )


def links_among(spark: SparkSession, sf: str, nodes: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` links whose both ends are in ``nodes``."""
    ids = nodes.select(F.col("node_id").alias("_id"))
    pairs = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")
    )
    return (
        pairs.join(ids, F.col("src") == F.col("_id"), "left_semi")
        .join(ids, F.col("dst") == F.col("_id"), "left_semi")
        .distinct()
    )


def document_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"))
    return nodes, links_among(spark, sf, nodes)


def vector_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"))
    return nodes, links_among(spark, sf, nodes)


def weighted_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Links between vectors, each reference with its quantity as ``weight``."""
    nodes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"))
    links = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("double").alias("weight")
    )
    ends = [F.col(c) == F.col("node_id") for c in ("src", "dst")]
    return nodes, links.join(nodes, ends[0], "left_semi").join(nodes, ends[1], "left_semi")


def histories(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, history)``: event type -> time of its first event, as a map."""
    events = table(spark, sf, "events")
    users = events.agg((F.max("user_id") + 1).alias("u")).scalar()
    first = events.groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))
    per_user = first.groupBy("user_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("event_type", F.date_trunc("second", "ts").cast("timestamp_ntz")))
        ).alias("history")
    )
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % users).alias("user_id"))
    return docs.join(per_user, "user_id").select("doc_id", "history")


def doc_authors(spark: SparkSession, sf: str) -> DataFrame:
    """``(node_id, author)``, distinct."""
    k = table(spark, sf, "documents").agg(F.count("*").alias("k")).scalar()
    return (
        table(spark, sf, "orders")
        .select((F.col("o_orderkey") % k).alias("node_id"), F.col("o_custkey").alias("author"))
        .distinct()
    )


def articles_full(spark: SparkSession, sf: str, *, texts: bool = True) -> DataFrame:
    """Raw articles with title, authors and history; without ``texts``, with a flag in their place."""
    raw = articles(spark, sf)
    base = (raw if texts else without_texts(raw)).withColumn("doc_id", F.col("pmid").cast("bigint"))
    authors = doc_authors(spark, sf).groupBy(F.col("node_id").alias("doc_id")).agg(
        F.sort_array(F.collect_list(F.col("author").cast("string"))).alias("authors")
    )
    history = histories(spark, sf).withColumn(
        "history", F.transform_values("history", lambda _, v: v.cast("string"))
    )
    return (
        base.join(authors, "doc_id", "left")
        .join(history, "doc_id", "left")
        .withColumn("title", F.concat(F.lit("Title, of "), F.col("pmid")))
        .drop("doc_id")
    )


def pages_and_links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Titled pages, and title links with repeated titles and unmatched targets."""
    part = table(spark, sf, "part")
    pages = part.select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("title"))
    missing = F.concat(F.lit("missing "), F.col("b.p_partkey").cast("string"))
    links = (
        part.alias("a")
        .join(part.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
        .select(
            F.col("a.p_name").alias("source"),
            F.when(F.col("b.p_partkey") % 10 == 0, missing).otherwise(F.col("b.p_name")).alias("target"),
        )
    )
    return pages, links


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``(node_id, label, pred)``; three quarters are right."""
    wrong = F.when(F.col("vec_id") % 4 == 0, 1 + F.col("vec_id") % 3).otherwise(F.lit(0))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("node_id"),
        F.col("label").cast("int").alias("label"),
        ((F.col("label") + wrong) % 10).cast("int").alias("pred"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """``(node_id, label, scores)``: ten scores per row, a linear map of the whole vector."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("node_id"),
        F.col("label").cast("int").alias("label"),
        linear(F.col("embedding").cast("array<double>"), formula_linear(10, 64)).alias("scores"),
    )


def epoch_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of three runs over ten epochs on one seeded split per run."""
    from ..operators.ordering import split_many

    modes = split_many(predictions(spark, sf), seeds=range(1, 4)).withColumnRenamed("seed", "run")
    rows = modes.join(predictions(spark, sf).drop("pred"), "node_id").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(9)))
    )
    right = (F.col("node_id") * 31 + F.col("epoch") * 17 + F.col("run") * 5) % 20 < (
        6 + (F.col("epoch") * 7 + F.col("run") * 3) % 11
    )
    return rows.withColumn(
        "pred", F.when(right, F.col("label")).otherwise((F.col("label") + 1) % 10)
    )


def epoch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    hit = (F.col("pred") == F.col("label")).cast("double")
    return epoch_predictions(spark, sf).groupBy("run", "mode", "epoch").agg(
        F.round(F.avg(hit), 4).alias("acc")
    )


def formula_linear(n_out: int, n_in: int, bias: bool = True) -> Linear:
    """Weights by formula, the same in the check SQL."""
    o, i = np.meshgrid(np.arange(n_out), np.arange(n_in), indexing="ij")
    weight = ((o * 31 + i * 17) % 13 - 6) / 13.0
    return Linear(weight, ((np.arange(n_out) * 7) % 5 - 2) / 10.0 if bias else None)


def formula_attention(n_in: int, heads: int, width: int, concat: bool) -> Attention:
    project = formula_linear(heads * width, n_in, bias=False)
    h, w = np.meshgrid(np.arange(heads), np.arange(width), indexing="ij")
    source = ((h * 5 + w * 3) % 7 - 3) / 7.0
    target = ((h * 3 + w * 5) % 7 - 3) / 7.0
    n_bias = heads * width if concat else width
    bias = ((np.arange(n_bias) * 7) % 5 - 2) / 10.0
    return Attention(project, source, target, bias, concat)
