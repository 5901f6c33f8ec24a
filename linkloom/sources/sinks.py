"""Writers. Appends are by task, so no result passes through one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.articles import drop_raw_fields, history_to_string


def write_articles(articles: DataFrame, path: str, *, by_id: bool = False) -> None:
    """One JSON object per article, without raw fields, event times as strings.

    ``by_id`` puts each article in a folder of its own (``pmid=...``) so that the
    landed ids can be listed; it suits small increments.
    """
    stored = drop_raw_fields(articles)
    if "history" in stored.columns:
        stored = history_to_string(stored)
    writer = stored.write.mode("append")
    if by_id:
        writer = writer.partitionBy("pmid")
    writer.json(path)


def write_nodes(nodes: DataFrame, path: str) -> None:
    """The node table with its index as CSV, texts as they are; arrays are stored as JSON text.

    ``readers.read_nodes`` reads it back, also where texts have line breaks.
    """
    flat = nodes
    for field in nodes.schema:
        if field.dataType.typeName() in ("array", "map", "struct"):
            flat = flat.withColumn(field.name, F.to_json(field.name))
    flat.write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


#: What names a row of metrics.
METRIC_KEY = ("run", "mode", "epoch")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Store metric rows (run, mode, epoch, values); a repeated epoch replaces the first.

    Rows lie in a folder per run, mode and epoch (those of them that are columns). The
    folders of the rows written are overwritten together when the job commits; others are
    not touched.
    """
    key = [c for c in METRIC_KEY if c in metrics.columns]
    writer = metrics.repartition(*key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*key).parquet(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored metrics; ``schema`` gives the types of all columns, those of the key included."""
    return spark.read.schema(schema).parquet(path)
