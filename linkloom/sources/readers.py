"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import store
from .split_records import ARRAY, CSV, OBJECT, in_order, read_records

ARTICLE_SCHEMA = (
    "pmid string, label string, abstract string, title string, "
    "authors array<string>, history map<string,string>, author_list array<array<string>>"
)
EDGE_SCHEMA = "source bigint, target bigint"
#: What stands for a field with nothing in it; an empty text is a pair of quotes.
NULL = "\x01null\x01"
#: Default place of the id in a landed file's path: its stem.
STEM = r"([^/]+)\.[^/.]+$"


def read_articles(
    spark: SparkSession, path: str, *, schema: str = ARTICLE_SCHEMA, one_document: bool = False
) -> DataFrame:
    """Articles from JSON with their order ``ord``; stored once, columns by column.

    By default each line holds one article or an array of articles, which Spark
    reads in splits. ``one_document`` reads files that are one array, over any lines;
    many tasks cut it into its elements. A line or element that is no article is an
    error. A schema with ``ord`` takes the order from the file.
    """
    if one_document:
        records = in_order(read_records(spark, path, ARRAY), "_ord", first=1)
        parsed = F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_article")
        rows = records.select("_ord", parsed).select("_article.*", "_ord")
        return store(rows.drop("_ord") if "ord" in rows.columns else rows.withColumnRenamed("_ord", "ord"), "articles")
    rows = spark.read.schema(schema).json(path, mode="FAILFAST")
    return store(rows, "articles") if "ord" in rows.columns else with_order(rows)


def with_order(rows: DataFrame, name: str = "ord") -> DataFrame:
    """Rows just read from files, with a unique number in the order of file, split and line.

    The rows are stored once, so that the number of a row never changes. Splits are
    numbered by their place (one row per split); the upper bits are that number.
    """
    placed = store(
        rows.select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        ),
        "placed-rows",
    )
    splits = placed.select("_file", "_block").distinct()
    numbered = splits.select(
        "_file", "_block", (F.row_number().over(Window.orderBy("_file", "_block")) - 1).cast("long").alias("_split")
    )
    line = F.col("_line").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(numbered, ["_file", "_block"]).withColumn(
        name, F.shiftleft("_split", 33).bitwiseOR(line)
    ).drop("_file", "_block", "_line", "_split")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGE_SCHEMA).csv(path, header=True, mode="FAILFAST")


def read_csv_records(spark: SparkSession, path: str, *, schema: str, header: bool = False, **options) -> DataFrame:
    """CSV whose quoted fields may go over lines, read by many tasks per file.

    Quotes in a field are doubled. A record that does not fit the schema is an error;
    ``header`` leaves the first record of each file out.
    """
    records = read_records(spark, path, CSV)
    if header:
        records = records.filter("number > 0")
    chosen = {"mode": "FAILFAST", "escape": '"', "multiLine": "true", "lineSep": "\n", **options}
    # a line end of the other kind is no part of the last field
    line = F.regexp_replace("value", "\r$", "")
    return records.select(F.from_csv(line, schema, chosen).alias("_record")).select("_record.*")


def read_headerless(
    spark: SparkSession, paths: dict[str, str], *, schema: str, column: str = "mode", one_line: bool = False
) -> DataFrame:
    """CSV files without header, each tagged with its own name, stacked.

    ``one_line`` says that no record has a line break, which needs one pass less.
    """
    from ..operators.citations import union_tagged

    def read(path: str) -> DataFrame:
        if one_line:
            return spark.read.schema(schema).csv(path, header=False, multiLine=False, escape='"', mode="FAILFAST")
        return read_csv_records(spark, path, schema=schema)

    return union_tagged({name: read(path) for name, path in paths.items()}, column)


def read_nodes(spark: SparkSession, path: str, *, schema: str) -> DataFrame:
    """The node table as ``write_nodes`` wrote it; columns that were no scalars are JSON text.

    Nulls, empty texts, blanks and line breaks come back as they were.
    """
    return read_csv_records(spark, path, schema=schema, header=True, nullValue=NULL)


def read_links(spark: SparkSession, path: str, *, one_document: bool = False) -> DataFrame:
    """``(source, target)`` from ``{title: [titles]}``.

    By default each line is one object; ``one_document`` takes a whole file as one,
    which many tasks cut into its members. Anything else is an error.
    """
    if one_document:
        members = read_records(spark, path, OBJECT)
        raw = members.select(F.concat(F.lit("{"), "value", F.lit("}")).alias("value"))
    else:
        raw = spark.read.text(path)
    parsed = F.from_json("value", "map<string,array<string>>", {"mode": "FAILFAST"})
    linked = raw.filter(F.trim("value") != "").select(parsed.alias("links"))
    return linked.select(F.explode("links").alias("source", "targets")).select(
        "source", F.explode("targets").alias("target")
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(pmid, label)`` from tab-separated lines.

    The label is the last character of the second field. Header lines do not
    start with a number and a tab. A repeated id keeps its last line, in order of
    file, split and line.
    """
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("place"),
    )
    fields = F.split("value", "\t")
    return (
        lines.filter(F.col("value").rlike(r"^\d+\t"))
        .select(fields[0].alias("pmid"), F.right(fields[1], F.lit(1)).alias("label"), "place")
        .groupBy("pmid")
        .agg(F.max_by("label", "place").alias("label"))
    )


def assemble_articles(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels joined to landed articles by id; an article without label keeps null."""
    return articles.drop("label").join(labels, "pmid", "left")


def landed_ids(spark: SparkSession, path: str, *, pattern: str = STEM) -> DataFrame:
    """Ids already landed, from file paths alone; no file is opened."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    return files.select(F.regexp_extract("path", pattern, 1).alias("pmid")).distinct()


def pending_ids(labels: DataFrame, landed: DataFrame) -> DataFrame:
    """Ids still to ingest: labelled ids without a landed file."""
    return labels.select("pmid").distinct().join(landed, "pmid", "left_anti")


def load_vectors(
    spark: SparkSession, path: str, *, id: str = "node_id", vec: str = "vec"
) -> DataFrame:
    """``(node_id, vec)`` from stored vectors; only the two columns are read."""
    return spark.read.parquet(path).select(
        F.col(id).alias("node_id"), F.col(vec).cast("array<double>").alias("vec")
    )
