"""Corpus pipeline: quality, line dedup, near duplicates, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep
the columns of ``docs``. Stages read whole texts and need ``doc_id`` and ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.decontaminate import drop_leaks
from linkloom.llm.jaccard import jaccard_components
from linkloom.llm.lines import dedup_lines
from linkloom.llm.packing import pack_documents
from linkloom.llm.quality import fit_quality, held_out, quality_score
from linkloom.llm.registry import table
from linkloom.session import store

#: Several stages are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    A null or empty text has the score of the bias and goes or stays by it; repeated rows
    go or stay together; an empty table stays empty; no column of the input is renamed or
    clashes, for none is added. Without labelled rows all scores are 0.5 and all rows stay.
    """
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    score = quality_score(spark, fit_quality(docs, labels))
    return docs.filter(score(F.col("text")) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines out that ten or more documents hold.

    A null text stays null, a text that loses all lines becomes empty, blank lines stay;
    repeated rows count as documents each; an empty table stays empty.
    """
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group; null ids are in no group.

    Where an id occurs on several rows, each row is a document of its own: equal texts
    leave one row, different texts under one id all stay, and so do empty texts.
    """
    counts = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count()
    if not counts.filter(F.col("count") > 1).isEmpty():
        return _near_duplicate_rows(docs)
    found = store(jaccard_components(docs), "near-duplicates")
    others = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def _near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` by a number for each row; the rows are stored once to keep it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = store(docs.select(row, F.monotonically_increasing_id().alias("_key")), "numbered-rows")
    known = rows.filter(F.col("_row.doc_id").isNotNull())
    found = store(
        jaccard_components(known.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text"))),
        "near-duplicates",
    ).select(F.col("doc_id").alias("_key"), "component_id")
    order = F.struct(F.col("_row.doc_id"), F.xxhash64("_row.text"), F.col("_key"))
    first = known.select("_key", order.alias("_order")).join(found, "_key").groupBy("component_id").agg(
        F.min("_order")["_key"].alias("_key")
    )
    kept = known.join(first.select("_key"), "_key", "left_semi").select("_row")
    return kept.unionByName(rows.filter(F.col("_row.doc_id").isNull()).select("_row")).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage.

    Null and empty texts hold none and stay; repeated rows go or stay together; without
    test items, or in an empty table, nothing changes.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 1024 tokens.

    A null or empty text is the end id alone; repeated rows are packed each; an empty
    table gives no pieces. The columns are those of the pieces.
    """
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is stored for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
