"""Records that go over many lines, read from one large file by many tasks.

Spark's readers for such files take a file as one task. Here the file is read in splits,
as pieces that end with a separator byte, and cut at its record boundaries:

1. Each split says what it does to the state of a scan, for both states it may begin in:
   whether it turns quotes on or off, and by how much brackets grow deeper. These are a row
   per split; running totals over them give the state in which each split begins.
2. Each split, its first state known, cuts its own records. What is left before its first
   boundary and after its last one belongs to records that began or go on elsewhere; these
   parts carry the number of their record and are joined, in the order of splits.

Texts of whole records are not shuffled; only the parts at the ends of splits are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import store

#: Bytes of a split that are scanned at once.
STEP = 4 << 20
QUOTE, BACKSLASH, COMMA, NEWLINE = (ord(x) for x in '"\\,\n')


def _open_quotes(data: np.ndarray, inside: bool, escapes: bool) -> tuple[np.ndarray, bool]:
    """Per byte, whether it lies within quotes (an opening quote does), and the state at the end."""
    quotes = np.flatnonzero(data == QUOTE)
    if escapes and len(quotes):
        slashes = data == BACKSLASH
        if slashes.any():
            places = np.arange(len(data))
            # the last byte before each quote that is no backslash
            plain = np.maximum.accumulate(np.where(slashes, -1, places))
            before = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1)
            quotes = quotes[(quotes - 1 - before) % 2 == 0]
    turns = np.zeros(len(data), dtype=np.int8)
    turns[quotes] = 1
    return (np.cumsum(turns, dtype=np.int32) + int(inside)) % 2 == 1, bool((len(quotes) + int(inside)) % 2)


@dataclass(frozen=True)
class State:
    """Where a scan stands: within quotes or not, and how deep in brackets."""

    inside: bool = False
    depth: int = 0


class CsvCuts:
    """Lines end records, but for line ends within quotes; a quote in a field is doubled."""

    separator = "\n"

    @staticmethod
    def scan(data: np.ndarray, state: State) -> tuple[np.ndarray, State]:
        """Places of boundary bytes, and the state after the data."""
        within, inside = _open_quotes(data, state.inside, escapes=False)
        return np.flatnonzero((data == NEWLINE) & ~within), State(inside)


_DEEPER = np.zeros(256, dtype=np.int8)
_DEEPER[[ord(x) for x in "[{"]] = 1
_DEEPER[[ord(x) for x in "]}"]] = -1


class JsonCuts:
    """Elements of one array, or members of one object, that is the whole document."""

    def __init__(self, separator: str):
        self.separator = separator

    @staticmethod
    def scan(data: np.ndarray, state: State) -> tuple[np.ndarray, State]:
        within, inside = _open_quotes(data, state.inside, escapes=True)
        deeper = _DEEPER[data]
        places = np.flatnonzero((deeper != 0) | (data == COMMA))
        places = places[~within[places]]
        steps = deeper[places]
        after = state.depth + np.cumsum(steps, dtype=np.int64)
        ends = (steps == 0) & (after == 1)  # a comma between elements
        ends |= (steps == 1) & (after == 1)  # the bracket that opens the document
        ends |= (steps == -1) & (after == 0)  # the one that closes it
        return places[ends], State(inside, int(after[-1]) if len(after) else state.depth)


ARRAY, OBJECT, CSV = JsonCuts("}"), JsonCuts("]"), CsvCuts()


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``(file, block, value)``: what lies between separators, in the order of the file within a split."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _split_data(batches, separator: bytes):
    """``(file, block, data)``: the bytes of each split again, some steps to a split."""
    at, held, size = None, [], 0
    for batch in batches:
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            if (file, block) != at:
                if held:
                    yield at, b"".join(held)
                # a separator stands before each piece but the first of the file
                at, held, size = (file, block), [] if block else [value], len(value)
                if not block:
                    continue
            held += (separator, value)
            size += len(value) + 1
            if size > STEP:
                yield at, b"".join(held)
                held, size = [], 0
    if held:
        yield at, b"".join(held)


def _effects(pieces: DataFrame, cuts) -> DataFrame:
    """``(file, block, turns, deeper_out, deeper_in)``: what each split does to the state."""

    def measure(batches):
        at, states = None, None
        out = []

        def effect():
            return (*at, states[0].inside, states[0].depth, states[1].depth)

        for split, data in _split_data(batches, cuts.separator.encode()):
            if split != at:
                if at is not None:
                    out.append(effect())
                at, states = split, (State(False), State(True))
            array = np.frombuffer(data, dtype=np.uint8)
            states = tuple(cuts.scan(array, state)[1] for state in states)
        if at is not None:
            out.append(effect())
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, kind) for v, kind in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)],
            names=["file", "block", "turns", "deeper_out", "deeper_in"],
        )

    return pieces.mapInArrow(measure, "file string, block long, turns boolean, deeper_out long, deeper_in long")


def _first_states(effects: DataFrame) -> DataFrame:
    """``(file, block, inside, depth)`` in which each split begins."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("turns").cast("int")).over(before), F.lit(0)) % 2 == 1
    deeper = F.when(F.col("inside"), F.col("deeper_in")).otherwise(F.col("deeper_out"))
    return effects.withColumn("inside", inside).withColumn(
        "depth", F.coalesce(F.sum(deeper).over(before), F.lit(0)).cast("long")
    ).select("file", "block", "inside", "depth")


def _parts(pieces: DataFrame, states: DataFrame, cuts) -> DataFrame:
    """``(file, block, at, last, value)``: the parts of each split between its boundaries."""

    def cut(batches):
        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, kind) for v, kind in zip(columns, kinds, strict=True)], names=["file", "block", "at", "last", "value"]
            )

        at, state, rest, count = None, None, [], 0
        first: dict[tuple[str, int], State] = {}

        def known(batches):
            for batch in batches:
                for file, block, inside, depth in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "inside", "depth")), strict=True):
                    first[file, block] = State(inside, depth)
                yield batch

        for split, data in _split_data(known(batches), cuts.separator.encode()):
            if split != at:
                if at is not None:
                    yield batch_of([(*at, count, True, b"".join(rest))])
                at, state, rest, count = split, first[split], [], 0
            places, state = cuts.scan(np.frombuffer(data, dtype=np.uint8), state)
            rows, start = [], 0
            for place in places.tolist():
                rows.append((*at, count, False, b"".join([*rest, data[start:place]])))
                rest, start, count = [], place + 1, count + 1
            rest.append(data[start:])
            if rows:
                yield batch_of(rows)
        if at is not None:
            yield batch_of([(*at, count, True, b"".join(rest))])

    # a row per split of input: some 100 bytes for spark.sql.files.maxPartitionBytes
    placed = pieces.join(F.broadcast(states), ["file", "block"])
    return placed.mapInArrow(cut, "file string, block long, at long, last boolean, value binary")


def read_records(spark: SparkSession, path: str, cuts) -> DataFrame:
    """``(file, number, value)``: the records of each file, numbered from 0; blank ones are left out.

    ``value`` is the record's own text, without what separates it from the next. The text
    is read twice, and stored once in the shared folder.
    """
    pieces = _pieces(spark, path, cuts.separator)
    states = store(_first_states(_effects(pieces, cuts)), "split-states")
    parts = store(_parts(pieces, states, cuts), "split-parts")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.filter("last").select(
        "file", "block", F.coalesce(F.sum("at").over(before), F.lit(0)).alias("base")
    )
    numbered = parts.join(F.broadcast(bases), ["file", "block"]).withColumn("number", F.col("base") + F.col("at"))
    # only the first and the last part of a split may go on in another
    # (what is filtered out has no value either: a parser may run before a filter)
    inner = ~F.col("last") & (F.col("at") > 0)
    whole = numbered.filter(inner).select("file", "number", F.when(inner, F.col("value")).alias("value"))
    ends = numbered.filter("last or at = 0").groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("_parts")
    ).select("file", "number", F.aggregate("_parts", F.lit(b""), lambda text, part: F.concat(text, part["value"])).alias("value"))
    text = F.decode("value", "utf-8")
    known = F.when(~text.rlike(r"^\s*$"), text)
    return whole.unionByName(ends).select("file", "number", known.alias("value")).filter(F.col("value").isNotNull())


def in_order(records: DataFrame, name: str = "ord", *, first: int = 0) -> DataFrame:
    """Records with one number in the order of files and records in place of both.

    ``first`` is the number of a file's first record: 1 in JSON, for what stands before
    the bracket that opens the document is number 0.
    """
    files = records.select("file").distinct().select(
        "file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("_file")
    )
    return records.join(F.broadcast(files), "file").withColumn(
        name, F.shiftleft("_file", 40).bitwiseOR(F.col("number") - first)
    ).drop("_file", "file", "number")
