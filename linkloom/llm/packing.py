"""Operator 9: packing of documents into fixed windows by non-negative least squares.

A document of n tokens gives n // W full pieces, sequences of their own, and a remainder.
Remainders are counted by length (fewer than W counts, so they fit the driver). Shallow
combinations of two or three lengths that fill a window exactly are enumerated; repeat
counts minimising the squared distance to the histogram are solved under x >= 0 by
accelerated projected gradient, rounded down and topped up while all lengths are left.
What no combination takes is packed greedily: laid end to end by length and cut at the
window's edge. Only the last, unfilled window is left; it is cut at powers of two, which
need no padding, so nothing is padded at all.

A piece finds its place by its rank among pieces of its length. Ranks are counted inside
tasks and shifted by counts per task, so a length that a third of all documents share
never meets in one task.

Defined cases: a null or empty text is the end id alone; repeated rows, nulls and equal
ids are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import hashing
from .encode import END_ID, encoder, tokenizer_path
from .registry import query, table

WINDOW = 1024
PIECES = (
    "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary, "
    "part long, row long, rank long"
)


def cut_pieces(docs: DataFrame, *, tokenizer: str, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Encode ``(doc_id, text)`` and cut; stored in the shared folder.

    A full piece is a sequence of its own and is never cut again, so only shorter pieces
    keep their ids. ``rank`` counts the pieces of one length in one task, ``(part, row)`` names a piece.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        ranks = np.zeros(window + 1, dtype=np.int64)
        for batch in hashing.text_steps(batches):
            out = []
            encoded = encoder(tokenizer).encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    kept = piece if length < window else None
                    out.append((doc_id, start, length, zlib.crc32(piece), total, kept, part, row, int(ranks[length])))
                    ranks[length] += 1
                    row += 1
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)],
                names=[field.split()[0] for field in PIECES.split(", ")],
            )

    path = scratch_path(docs.sparkSession, "pieces")
    docs.select("doc_id", "text").mapInArrow(cut, PIECES).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(PIECES).parquet(path)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three ascending lengths (0: none) out of ``lengths`` that sum to ``window``."""
    here = np.zeros(window + 1, dtype=bool)
    here[lengths] = True
    small, large = np.meshgrid(np.append(0, lengths), lengths, indexing="ij")
    rest = window - small - large
    fits = (small <= large) & (rest >= large) & (rest > 0)
    fits &= here[np.clip(rest, 0, window)]
    return np.stack([small[fits], large[fits], rest[fits]], axis=1)


def solve(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts of the patterns closest to the histogram in squares."""
    used = (patterns > 0).astype(float)

    def uses(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), (used * x[:, None]).ravel(), minlength=len(histogram))

    def gradient(x: np.ndarray) -> np.ndarray:
        return (used * (uses(x) - histogram)[patterns]).sum(axis=1)

    # the largest row sum times the largest column sum of A'A bounds its norm
    step = 1.0 / (3 * max(1.0, uses(np.ones(len(patterns))).max()))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * gradient(y))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


@dataclass(frozen=True)
class Plan:
    """Rows ``(length, low, high, sequence, offset)``: where the ranks of a length go."""

    places: list[tuple[int, int, int, int, int]]
    #: Rows ``(length, low, position)``: ranks from ``low`` on lie end to end from ``position``.
    rest: list[tuple[int, int, int]]
    first_rest: int
    rest_tokens: int


def plan_packing(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Decide from the number of pieces per length; the work does not grow with the documents."""
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, count in counts.items():
        histogram[length] = count
    places, sequence = [(window, 0, int(histogram[window]), 0, 0)], int(histogram[window])
    left, taken = histogram.copy(), np.zeros(window + 1, dtype=np.int64)
    left[window] = 0
    patterns = combinations(np.flatnonzero(left), window)
    if len(patterns):
        x = solve(patterns, left.astype(float))
        order = np.argsort(-x, kind="stable")
        for wanted in (np.floor(x + 1e-6), np.full(len(x), np.inf)):  # rounded, then topped up
            for i in order:
                lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
                repeat = int(min(wanted[i], (left[lengths] // times).min()))
                if repeat <= 0:
                    continue
                offset = 0
                for length in patterns[i][patterns[i] > 0].tolist():
                    places.append((length, int(taken[length]), int(taken[length]) + repeat, sequence, offset))
                    taken[length] += repeat
                    left[length] -= repeat
                    offset += length
                sequence += repeat
    rest, position = [], 0
    for length in np.flatnonzero(left).tolist():
        rest.append((length, int(taken[length]), position))
        position += length * int(left[length])
    return Plan(places, rest, sequence, position)


def tail_cuts(tokens: int, window: int) -> list[int]:
    """Positions that cut the last, unfilled window into powers of two, largest first."""
    at, cuts = tokens - tokens % window, []
    for bit in reversed(range(window.bit_length() - 1)):
        if (tokens % window) >> bit & 1:
            cuts.append(at)
            at += 1 << bit
    return [*cuts, at] if cuts else []


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` per packed piece."""
    spark = pieces.sparkSession
    narrow = pieces.drop("ids")
    counts = narrow.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # at most `window` rows
    plan = plan_packing({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)
    places = spark.createDataFrame(plan.places, "_length int, _low long, _high long, _seq long, _offset long")
    rest = spark.createDataFrame(plan.rest, "_length int, _low long, _position long")
    ranked = narrow.join(shifts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("shift")
    same = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_low"))
    # both tables have a few thousand rows at most, by the number of lengths
    placed = ranked.join(F.broadcast(places), same & (F.col("rank") < F.col("_high"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_seq") + F.col("rank") - F.col("_low")).alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )
    if not plan.rest:
        return placed
    cuts = tail_cuts(plan.rest_tokens, window)
    whole = plan.rest_tokens // window
    edges = F.array(*[F.lit(cut).cast("long") for cut in cuts]) if cuts else F.array().cast("array<bigint>")
    first, last = F.col("_at"), F.col("_at") + F.col("length")
    laid = ranked.join(F.broadcast(rest), same).withColumn(
        "_at", F.col("_position") + (F.col("rank") - F.col("_low")) * F.col("length")
    ).withColumn(
        "_edges",
        F.array_sort(F.array_distinct(F.concat(
            F.array(first, last),
            F.filter(
                F.concat(F.array(F.floor(last / window).cast("long") * window), edges),
                lambda edge: (edge > first) & (edge < last),
            ),
        ))),
    )
    parts = laid.select(
        "*", F.explode(F.sequence(F.lit(0), F.size("_edges") - 2)).alias("_i")
    ).select(
        "*", F.col("_edges")[F.col("_i")].alias("_from"), F.col("_edges")[F.col("_i") + 1].alias("_to")
    ).select(
        "doc_id", "part", "row", "doc_tokens", "ids_crc32", (F.size("_edges") > 2).alias("_cut"),
        F.col("start").alias("_start"), (F.col("start") + F.col("_from") - F.col("_at")).alias("start"),
        (F.col("_to") - F.col("_from")).cast("int").alias("length"),
        *_tail_place(F.col("_from"), cuts, whole, window, plan.first_rest),
    )
    columns = placed.columns
    uncut = parts.filter(~F.col("_cut")).select(columns)
    # about one remainder in as many as fill a window is cut; its part needs its own checksum
    recut = parts.filter("_cut").join(pieces.select("part", "row", "ids"), ["part", "row"]).withColumn(
        "ids_crc32",
        F.crc32(F.expr("substring(ids, cast(4 * (start - _start) + 1 as int), 4 * length)")),
    ).select(columns)
    return placed.unionByName(uncut).unionByName(recut)


def _tail_place(position, cuts: list[int], whole: int, window: int, first: int):
    """Sequence and offset of a position in what is laid end to end."""
    sequence = F.lit(first) + F.floor(position / window).cast("long")
    offset = position % window
    for i, cut in enumerate(cuts[:-1]):
        sequence = F.when(position >= cut, F.lit(first + whole + i)).otherwise(sequence)
        offset = F.when(position >= cut, position - cut).otherwise(offset)
    return sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset")


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    return pack(cut_pieces(docs, tokenizer=tokenizer or tokenizer_path())).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        "sequence_id", F.col("offset").cast("long").alias("offset"),
    )


@query("op9_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
