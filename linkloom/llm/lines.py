"""Operator 10: line dedup with levelled runs of line hashes.

A run is a Parquet table ``(line, docs)`` sorted by the 64-bit hash of the line key,
with the number of documents of its batch that hold the line. New runs enter level 0;
as soon as a level holds ``fanout`` runs they are merged into one run of the next
level. A line drops by the number of documents that hold it, earlier or later, so all
batches are added first, the runs are counted by a group on the hash, and the rows are
semi-joined with the frequent lines (the very frequent ones by broadcast). No batch is
anti-joined with the runs on the way; ``LineRuns.unseen`` is that step, for callers that
drop by mere presence. Nothing relies on the sorted order of the runs.

Only built-in functions are used. Defined cases: a null or empty text is one empty
line; a line whose key is shorter than ``min_chars`` is never dropped; repeated rows
count as separate documents; an empty table gives an empty result; columns other than
the id and the text pass through ``dedup_lines`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, store
from .registry import query, table

#: White space stripped from a line, letters folded.
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A line held by more than 1/HEAVY_SHARE of all (document, line) rows is matched by
#: broadcast; there are fewer than HEAVY_SHARE such lines.
HEAVY_SHARE = 10_000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs below one folder of the shared storage."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 3):
        self.spark = spark
        self.path = path or scratch_path(spark, "line-runs")
        self.fanout = fanout
        self.levels: list[list[str]] = []
        self._written = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = f"{self.path}/run-{self._written:05d}"
        self._written += 1
        rows.sortWithinPartitions("line").write.parquet(path)
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("line long, docs long").parquet(*paths)

    def add(self, keys: DataFrame) -> None:
        """Add a batch of ``(line)`` rows, one for each document and line."""
        self._write(keys.groupBy("line").agg(F.count("*").alias("docs")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._read(full).groupBy("line").agg(F.sum("docs").alias("docs")), level + 1)
            level += 1

    def counts(self) -> DataFrame:
        """``(line, docs)`` over all runs."""
        paths = [path for level in self.levels for path in level]
        if not paths:
            return self.spark.createDataFrame([], "line long, docs long")
        return self._read(paths).groupBy("line").agg(F.sum("docs").alias("docs"))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch whose line is in no run."""
        return keys.join(self.counts().select("line"), "line", "left_anti")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """Documents in one struct, with a 128-bit hash of text and row (maps have no hash).

    Fully equal rows share it; they lose equal lines.
    """
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.xxhash64(F.lit(1), F.col(text)).alias("_a"),
        F.xxhash64(F.lit(2), *[F.col(f"`{c}`") for c in hashed]).alias("_b"),
        text_lines(F.col(text)).alias("_lines"),
    )


def dropped_lines(
    docs: DataFrame, *, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4
) -> DataFrame:
    """``(_row, _lines, _kept)``: each document, its lines, and those that stay.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents loses all its lines. The table is taken as ``batches`` batches, each of
    which adds its run; the batches together are the whole table.
    """
    keyed = _keyed(docs, text)
    keys = keyed.select(
        "_a", "_b", F.explode(F.array_distinct(F.transform("_lines", line_key))).alias("_key")
    ).filter(F.length("_key") >= min_chars)
    narrow = store(
        keys.select(
            "_a", "_b", F.xxhash64("_key").alias("line"), F.pmod("_b", F.lit(batches)).alias("_batch")
        ),
        "line-keys",
    )
    runs = LineRuns(docs.sparkSession)
    for batch in range(batches):
        runs.add(narrow.filter(F.col("_batch") == batch).select("line"))
    frequent = store(runs.counts().filter(F.col("docs") >= min_docs), "frequent-lines")
    bound = max(min_docs, narrow.count() // HEAVY_SHARE)
    heavy = frequent.filter(F.col("docs") > bound).select("line")
    light = frequent.filter(F.col("docs") <= bound).select("line")
    found = narrow.join(F.broadcast(heavy), "line", "left_semi").unionByName(
        narrow.join(F.broadcast(heavy), "line", "left_anti").join(light.hint("merge"), "line", "left_semi")
    )
    lists = found.groupBy("_a", "_b").agg(F.collect_set("line").alias("_drop"))
    matched = keyed.join(lists, ["_a", "_b"], "left").withColumn(
        "_drop", F.coalesce("_drop", F.array().cast("array<bigint>"))
    )

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.length(key) < min_chars) | ~F.array_contains(F.col("_drop"), F.xxhash64(key))

    return matched.select(
        "_row", "_lines",
        F.when(F.size("_drop") == 0, F.col("_lines")).otherwise(F.filter("_lines", stays)).alias("_kept"),
    )


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with frequent lines taken out of their texts; same columns."""
    text = options.get("text", "text")
    rows = dropped_lines(docs, **options)
    new = F.when(
        F.size("_kept") == F.size("_lines"), F.col(f"_row.{text}")
    ).otherwise(F.concat_ws("\n", "_kept"))
    return rows.select(
        *[new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    )


LINE_SQL = """
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
hot as (select key from (select distinct r, key from k where length(key) >= 1) group by key having count(*) >= 10),
m as (select k.*, hot.key is not null as drops from k left join hot on k.key = hot.key)
select any_value(doc_id) as doc_id, count(*) as n_lines,
  count(*) filter (where drops) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not drops), '')) as kept_sha256
from m group by r
"""


@query("op10_line_dedup", LINE_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dropped_lines(docs).select(
        F.col("_row.doc_id").alias("doc_id"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.sha2(F.concat_ws("\n", "_kept"), 256).alias("kept_sha256"),
    )
