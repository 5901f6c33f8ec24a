"""A landing place with a log: what has arrived is read from the log, not from a listing.

Each delivery is a folder of JSON lines and an entry of the log with a row per id and
file. An entry is written after its delivery, so an id in the log has landed whole; a
delivery that was cut off has no entry and is delivered again. Entries are merged by
``compact``. All reads of the log remove repeats, so merging or repeating changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import write_articles

ENTRY = "pmid string, file string"


class Landing:
    """Articles under ``path/articles`` and their log under ``path/log``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = f"{self.path}/log"
        # an empty entry, so that the log can always be read
        spark.createDataFrame([], f"{ENTRY}, entry string").write.mode("append").partitionBy("entry").parquet(self.log)

    def deliver(self, articles: DataFrame) -> str:
        """Write articles and then their entry; returns the name of the delivery."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/articles/{name}"
        write_articles(articles, folder)
        landed = self.spark.read.schema("pmid string").json(folder, mode="FAILFAST")
        rows = landed.filter(F.col("pmid").isNotNull()).select("pmid", F.col("_metadata.file_path").alias("file")).distinct()
        rows.write.parquet(f"{self.log}/entry={name}")
        return name

    def entries(self) -> DataFrame:
        """``(pmid, file)``, a row for each id and file."""
        return self.spark.read.schema(f"{ENTRY}, entry string").parquet(self.log).select("pmid", "file").distinct()

    def ids(self) -> DataFrame:
        """The ids that have landed; only the ids of the log are read."""
        return self.spark.read.schema(f"{ENTRY}, entry string").parquet(self.log).select("pmid").distinct()

    def articles(self, schema: str) -> DataFrame:
        """All delivered articles."""
        return self.spark.read.schema(schema).json(f"{self.path}/articles/*", mode="FAILFAST")

    def compact(self) -> None:
        """Merge the entries there are now into one; those written meanwhile stay as they are.

        The merged entry is written before the others go, so a run that is cut off in
        between leaves repeats at worst.
        """
        names = [
            row["entry"] for row in self.spark.read.schema(f"{ENTRY}, entry string").parquet(self.log)
            .select("entry").distinct().collect()  # a row per delivery since the last time
        ]
        if len(names) < 2:
            return
        merged = self.spark.read.schema(f"{ENTRY}, entry string").parquet(self.log).filter(F.col("entry").isin(names))
        merged.select("pmid", "file").distinct().write.parquet(f"{self.log}/entry={uuid.uuid4().hex}")
        jvm = self.spark.sparkContext._jvm
        for name in names:
            old = jvm.org.apache.hadoop.fs.Path(f"{self.log}/entry={name}")
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
