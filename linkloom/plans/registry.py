"""The registered queries and, where SQL can state them, their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_array

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its check SQL."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return add


def num(column: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def long(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Vectors as rounded ``(node_id, dim, value)`` rows."""
    return vectors.select("node_id", F.posexplode(as_array(vectors, vec)).alias("dim", "value")).select(
        "node_id", "dim", num("value").alias("value")
    )
