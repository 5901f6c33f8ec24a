"""Exact positions at scale: dense ids, seeded splits, mini-batches, best epochs.

No operator here sorts a whole table in one task. Positions come from counts per
bucket (a table with a bounded number of rows) plus a rank inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: The shares of the train and validation splits.
TRAIN_SHARE = 0.7
VALID_SHARE = 1 / 3
MODES = ("train", "valid", "test")
#: Rows per batch and train batches used per epoch.
BATCH_ROWS = 32
BATCH_CAP = 150

#: Rows per bucket when ranking by a dense id.
ID_BUCKET = 131_072
#: Leading hex digits of a hash that make a bucket: 65,536 even buckets.
HASH_DIGITS = 4


def bucketed_rank(
    df: DataFrame,
    bucket: Column,
    order: list,
    *,
    within: tuple[str, ...] = (),
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """0-based rank by ``(bucket, *order)``, inside each value of ``within``.

    ``bucket`` must be monotone in the wanted order and have a bounded number of
    values: their counts are summed up in one small window and broadcast.
    """
    keys = [*within, "_bucket"]
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys).agg(F.count("*").alias("_rows"))
    scope = Window.partitionBy(*within)
    earlier = scope.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(scope).alias("_total"),
    )
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    ranked = (
        tagged.withColumn("_inner", inner)
        .join(F.broadcast(offsets), keys)
        .withColumn(name, F.col("_before") + F.col("_inner"))
    )
    if total:
        ranked = ranked.withColumnRenamed("_total", total)
    return ranked.drop("_bucket", "_inner", "_before", "_total")


def hash_rank(df: DataFrame, salt: Column, id: str, **options) -> DataFrame:
    """Rank by ``md5(salt:id)``, a repeatable shuffle of the rows."""
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", salt, F.col(id).cast("string"))))
    bucket = F.conv(F.substring("_hash", 1, HASH_DIGITS), 16, 10).cast("int")
    return bucketed_rank(hashed, bucket, ["_hash", id], **options).drop("_hash")


def id_rank(df: DataFrame, id: str = "node_id", **options) -> DataFrame:
    """Rank by a dense integer id (ids without long gaps, such as node ids)."""
    bucket = F.floor(F.col(id) / F.lit(ID_BUCKET))
    return bucketed_rank(df, bucket, [id], **options)


def dense_id_map(df: DataFrame, order: str, *carried: str, name: str = "node_id") -> DataFrame:
    """``(order, *carried, node_id)`` with consecutive ids from 0 in the given order.

    ``order`` must be unique. Only these narrow columns are sorted, by range over
    all tasks. The sorted rows are settled once, because the offsets and the ids
    must see the same partitions even if an executor is lost.
    """
    ordered = (
        df.select(order, *[c for c in carried if c != order])
        .sort(order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    ordered = settle(ordered).withColumns({
        "_part": F.shiftright("_place", 33),
        "_inner": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_inner"))
        .drop("_part", "_place", "_inner", "_before")
    )


def dense_ids(df: DataFrame, order: str, *, name: str = "node_id", onto: DataFrame | None = None) -> DataFrame:
    """Add consecutive ids from 0 in the given (unique) order, to the rows of ``onto`` if given."""
    return (df if onto is None else onto).join(dense_id_map(df, order, name=name), order)


def _mode_of(rank: Column, total: Column) -> Column:
    n_train = F.floor(F.lit(TRAIN_SHARE) * total)
    n_valid = F.floor(F.lit(VALID_SHARE) * (total - n_train))
    return (
        F.when(rank < n_train, MODES[0]).when(rank < n_train + n_valid, MODES[1]).otherwise(MODES[2])
    )


def split(nodes: DataFrame, *, seed: int = 1, id: str = "node_id") -> DataFrame:
    """Add ``mode``: an exact, seeded, unstratified 70/10/20 split."""
    ranks = hash_rank(
        nodes.select(id), F.lit(str(seed)), id, name="_rank", total="_n"
    )
    modes = ranks.select(id, _mode_of(F.col("_rank"), F.col("_n")).alias("mode"))
    return nodes.join(modes, id)


def split_many(nodes: DataFrame, *, seeds: range = range(1, 11), id: str = "node_id") -> DataFrame:
    """The same split for several seeds: ``(seed, node_id, mode)``."""
    rows = nodes.select(
        id, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    )
    ranks = hash_rank(
        rows, F.col("seed").cast("string"), id, within=("seed",), name="_rank", total="_n"
    )
    return ranks.select("seed", id, _mode_of(F.col("_rank"), F.col("_n")).alias("mode"))


def split_view(nodes: DataFrame, mode: str) -> DataFrame:
    """The rows of one split; an unknown name is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: expected one of {MODES}")
    return nodes.filter(F.col("mode") == mode)


def labels_of(nodes: DataFrame, mode: str | None = None, id: str = "node_id") -> DataFrame:
    view = nodes if mode is None else split_view(nodes, mode)
    return view.select(id, "label")


def rows_at(
    nodes: DataFrame, positions: tuple[int, int], *, mode: str | None = None, id: str = "node_id"
) -> DataFrame:
    """Rows ``first <= position < last`` of the current view, with their position."""
    view = nodes if mode is None else split_view(nodes, mode)
    first, last = positions
    places = id_rank(view.select(id), id, name="position").filter(
        (F.col("position") >= first) & (F.col("position") < last)
    )
    return view.join(places, id)


def minibatches(
    nodes: DataFrame, *, epoch: int = 0, seed: int = 1, size: int = BATCH_ROWS, id: str = "node_id"
) -> DataFrame:
    """Add ``batch_id``: train rows shuffled per epoch, the other splits in order."""
    narrow = nodes.select(id, "mode")
    train = hash_rank(
        narrow.filter(F.col("mode") == MODES[0]), F.lit(f"{seed}:{epoch}"), id, name="_rank"
    )
    others = id_rank(
        narrow.filter(F.col("mode") != MODES[0]), id, within=("mode",), name="_rank"
    )
    batches = train.unionByName(others).select(
        id, F.floor(F.col("_rank") / F.lit(size)).cast("bigint").alias("batch_id")
    )
    return nodes.join(batches, id)


def batch_cap(batches: DataFrame, cap: int = BATCH_CAP) -> DataFrame:
    """The first batches of the train split, as one training epoch uses them."""
    return batches.filter((F.col("mode") == MODES[0]) & (F.col("batch_id") < cap))


def best_so_far(metrics: DataFrame) -> DataFrame:
    """Epochs whose validation accuracy strictly beats all earlier ones, from 0.

    A run holds one row per epoch, so its window is small.
    """
    earlier = (
        Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    )
    valid = metrics.filter(F.col("mode") == "valid")
    record = F.coalesce(F.max("acc").over(earlier), F.lit(0.0))
    return valid.withColumn("_record", record).filter(F.col("acc") > F.col("_record")).drop("_record")


def test_at_best(metrics: DataFrame) -> DataFrame:
    """Test metrics at each best epoch and, once more, at the end of the run."""
    tests = metrics.filter(F.col("mode") == "test")
    best = tests.join(best_so_far(metrics).select("run", "epoch"), ["run", "epoch"])
    ends = metrics.groupBy("run").agg(F.max("epoch").alias("epoch"))
    last = tests.join(ends, ["run", "epoch"])
    return best.withColumn("moment", F.lit("best")).unionByName(
        last.withColumn("moment", F.lit("end"))
    )
