"""Many-to-one joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/TARGET_SHARES of the rows.
TARGET_SHARES = 1000
#: Keys the sketch may report. There are at most TARGET_SHARES true hot keys.
MAX_HOT = TARGET_SHARES
#: Below this many rows per key splitting gains nothing.
MIN_ROWS = 1_000_000


@dataclass(frozen=True)
class HotKeys:
    """Hot keys of one column with the number of parts each is split into."""

    parts: dict = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.parts)


def hot_keys(df: DataFrame, *columns: str, min_rows: int = MIN_ROWS) -> dict[str, HotKeys]:
    """Measure the hot keys of each column in one pass.

    A frequent-items sketch needs no shuffle by key, and its result is at most
    ``MAX_HOT`` keys per column. It only steers how rows are spread: a key that
    is missed or over-counted changes no result.
    """
    sketch = [
        F.expr(f"approx_top_k({column}, {MAX_HOT}, {16 * MAX_HOT})").alias(column)
        for column in columns
    ]
    row = df.agg(F.count("*").alias("_rows"), *sketch).first()
    share = max(row["_rows"] / TARGET_SHARES, min_rows)
    found = {}
    for column in columns:
        found[column] = HotKeys({
            item["item"]: int(item["count"] // share) + 1
            for item in row[column] or []
            if item["item"] is not None and item["count"] > share
        })
    return found


def lookup_join(
    many: DataFrame,
    one: DataFrame,
    many_key: str,
    one_key: str,
    *,
    hot: HotKeys | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join each row of ``many`` to the row of ``one`` with its key; keeps both keys.

    Rows of a hot key are spread over several parts by a hash of the row, and the
    matching row of ``one`` is repeated once per part, so the result is the plain
    join. The list of hot keys is broadcast; it has at most ``MAX_HOT`` rows.
    """
    if how not in ("inner", "left"):
        raise ValueError("lookup_join supports inner and left joins")
    if not hot:
        return many.join(one, F.col(many_key) == F.col(one_key), how)
    key_type = many.schema[many_key].dataType.simpleString()
    table = F.broadcast(
        many.sparkSession.createDataFrame(
            list(hot.parts.items()), f"_hot {key_type}, _parts int"
        )
    )
    spread = (
        many.join(table, F.col(many_key) == F.col("_hot"), "left")
        .withColumn(
            "_part",
            F.when(
                F.col("_parts").isNotNull(),
                F.pmod(F.xxhash64(*many.columns), F.col("_parts")).cast("int"),
            ).otherwise(0),
        )
        .drop("_hot", "_parts")
    )
    repeated = (
        one.join(table, F.col(one_key) == F.col("_hot"), "left")
        .withColumn(
            "_one_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
        )
        .drop("_hot", "_parts")
    )
    matched = (F.col(many_key) == F.col(one_key)) & (F.col("_part") == F.col("_one_part"))
    return spread.join(repeated, matched, how).drop("_part", "_one_part")
