"""Cleaning of raw articles into nodes, and projections of single articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the marker put in front of a text that carries graph context.
CONTEXT_PREFIX = "<GC> "
#: Raw fields that are not stored.
RAW_FIELDS = ("content", "xml")


def first_per_key(articles: DataFrame, *, key: str = "pmid", order: str = "ord") -> DataFrame:
    """Keep the first row per key in input order.

    Spark limits the rank inside each task before the shuffle, so a key with very
    many copies sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return articles.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def with_label_and_text(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("label").isNotNull() & F.col("abstract").isNotNull())


def cast_ids(articles: DataFrame) -> DataFrame:
    """Label and article id as integers; under ANSI mode a bad value is an error."""
    return articles.withColumns(
        {"label": F.col("label").cast("int"), "text_id": F.col("pmid").cast("bigint")}
    )


def without_texts(articles: DataFrame, *carried) -> DataFrame:
    """The columns that decide which articles stay, with a flag for the text.

    Cleaning these first keeps texts out of the shuffle that finds first rows.
    ``carried`` are further narrow columns, such as a length of the text.
    """
    flag = F.when(F.col("abstract").isNotNull(), True)
    return articles.select("ord", "pmid", "label", flag.alias("abstract"), *carried)


def first_event_time(history: Column | str) -> Column:
    """Time of the smallest value of an event map; null for an empty map."""
    return F.to_timestamp_ntz(F.array_min(F.map_values(history)))


def clean_keys(articles: DataFrame, *carried) -> DataFrame:
    """``(ord, pmid, label, text_id)`` and the carried columns of the articles that stay.

    The first row of an id is chosen before incomplete rows are dropped: an id
    whose first row is incomplete is lost even if a later row is complete.
    """
    kept = cast_ids(with_label_and_text(first_per_key(without_texts(articles, *carried))))
    return kept.drop("abstract")


def clean_articles(articles: DataFrame, *, keys: DataFrame | None = None) -> DataFrame:
    """Raw articles to nodes without ids.

    What stays is decided on narrow columns; the texts are joined once, by order and id.
    Optional columns (authors, title, history) are carried when present. ``keys`` are the
    ``clean_keys`` of the articles where they are at hand, with any columns to add.
    """
    columns = [F.col("abstract").alias("text")]
    columns += [name for name in ("authors", "title") if name in articles.columns]
    if "history" in articles.columns:
        columns.append(first_event_time("history").alias("time"))
    texts = articles.select("ord", "pmid", *columns)
    return texts.join(clean_keys(articles) if keys is None else keys, ["ord", "pmid"]).drop("pmid")


def check_order(kept: DataFrame) -> DataFrame:
    """The stored rows, unless an order is null or repeated: then an error."""
    wrong = kept.groupBy("ord").agg(F.count("*").alias("_n")).filter(
        F.col("ord").isNull() | (F.col("_n") > 1)
    )
    if not wrong.isEmpty():
        raise ValueError("the order of the articles is null or repeated")
    return kept


def history_to_string(articles: DataFrame) -> DataFrame:
    """Every value of the event map as a string."""
    return articles.withColumn(
        "history", F.transform_values("history", lambda _, value: value.cast("string"))
    )


def author_affiliations(articles: DataFrame, field: str = "affiliations") -> DataFrame:
    """Replace each author of ``author_list`` by their affiliations."""
    return articles.withColumn(
        "author_list", F.transform("author_list", lambda author: author[field])
    )


def drop_raw_fields(articles: DataFrame) -> DataFrame:
    return articles.drop(*RAW_FIELDS)


def with_context_prefix(nodes: DataFrame, enabled: bool = True) -> DataFrame:
    if not enabled:
        return nodes
    return nodes.withColumn("text", F.concat(F.lit(CONTEXT_PREFIX), F.col("text")))


def apply_to(nodes: DataFrame, column: str, function: Callable[[Column], Column]) -> DataFrame:
    """Apply a caller's function (native expression or pandas UDF) to one column."""
    return nodes.withColumn(column, function(F.col(column)))


def all_authors(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("authors").alias("author")).distinct()
