"""Session helpers: shared scratch space, lineage cuts and suggested settings."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the library is measured with. Callers may set their own instead.
SUGGESTED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the suggested runtime settings to a session and return it."""
    for key, value in SUGGESTED.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Where neither that nor a checkpoint
    directory is set, the warehouse serves; a warehouse on the disk of one machine is
    refused unless Spark runs on that machine alone.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:/"):
        warehouse = "/" + warehouse.removeprefix("file:").lstrip("/")
    if warehouse.startswith("/") and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_linkloom"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, store it reliably and cut its lineage."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


def settle_by(df: DataFrame, key: str) -> DataFrame:
    """``settle`` with the rows dealt and sorted by ``key``: joins of such tables by it shuffle nothing.

    Adaptive execution forgets how stored rows are dealt, so it rests meanwhile.
    """
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    parts, before = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return settle(df.repartition(parts, key).sortWithinPartitions(key))
    finally:
        spark.conf.set(name, before)


def drop_finished(spark: SparkSession, wait: float = 0.0) -> None:
    """Let Spark's cleaner remove the shuffle files of steps whose results are stored.

    It works beside the next step; ``wait`` gives it so many seconds before that.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(wait)


def store(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Like ``settle``, but later readers only read the columns they use. Meant for
    tables that hold texts.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
