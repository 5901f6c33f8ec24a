"""Resumable ingest of landed article files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import ARTICLE_SCHEMA

#: Folder of the ledger of stored ids; readers of the store pass it over.
LEDGER = "_ids"


def _run_name(spark: SparkSession, checkpoint: str) -> str:
    """A name kept with the checkpoint: a new checkpoint starts anew without clashes."""
    place = f"{checkpoint.rstrip('/')}/_linkloom_name"
    spark.createDataFrame([(uuid.uuid4().hex,)], "name string").coalesce(1).write.mode("ignore").json(place)
    return spark.read.schema("name string").json(place).first()["name"]


def ingest_new_articles(
    spark: SparkSession,
    landing: str,
    store: str,
    checkpoint: str,
    *,
    schema: str = ARTICLE_SCHEMA,
    files_per_trigger: int = 10_000,
) -> None:
    """Move all files that landed since the last run into the store, then stop.

    The checkpoint remembers finished files only. Which ids are stored is a ledger of ids
    beside the store, read once per batch, so no state grows with the history. Each batch
    overwrites its own folder of articles and then its own entry of the ledger; a batch
    that was cut off is replayed with the same number, does not see its own entry, and so
    stores the same rows once. Rows without an id are left out; of rows of one id in a
    batch one is kept.
    """
    store = store.rstrip("/")
    name = _run_name(spark, checkpoint)
    ledger = f"{store}/{LEDGER}"
    spark.createDataFrame([], "pmid string, batch string").write.mode("append").partitionBy("batch").parquet(ledger)

    def add(rows: DataFrame, number: int) -> None:
        session, batch = rows.sparkSession, f"{name}-{number}"
        known = session.read.schema("pmid string, batch string").parquet(ledger).filter(F.col("batch") != batch)
        new = rows.filter(F.col("pmid").isNotNull()).dropDuplicates(["pmid"]).join(known, "pmid", "left_anti")
        folder = f"{store}/batch={batch}"
        new.select(rows.columns).write.mode("overwrite").parquet(folder)
        stored = session.read.schema(rows.schema).parquet(folder)
        stored.select("pmid").write.mode("overwrite").parquet(f"{ledger}/batch={batch}")

    landed = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .option("mode", "FAILFAST")
        .json(landing)
    )
    (
        landed.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
