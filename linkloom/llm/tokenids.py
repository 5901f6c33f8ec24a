"""Operator 5: token ids in directly addressable codes (Brisaboa et al., "DACs", 2013).

A file holds segments of at most ``SEGMENT`` ids. In a segment, level k holds the k-th
byte of every id that has one, a bitmap tells which of them go on in level k+1, and a
rank directory counts the set bits before every ``BLOCK`` bits. An id is found by
following the levels: a look at a byte and a rank per level, nothing is decoded around it.

File: magic, segments, document table (id, first position, count), segment table
(first position, byte offset), and a fixed-size tail with the places of both tables.

Files are named after the attempt that wrote them; only those named in the manifest,
which Spark commits once per task, count. Defined cases: a null or empty text is the end
id alone; rows are in ascending order of id, nulls first, ties by text; repeated rows are
written each; an empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, store
from . import hashing
from .encode import END_ID, encoder, tokenizer_path
from .registry import query, table

SEGMENT = 1 << 20
BLOCK = 512
MAGIC = b"DACIDS01"
_TAIL = struct.Struct("<QQQQQ")  # places and sizes of both tables, number of ids
_NONE = -(2**63)  # stands for a null id
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint16)


def pack_segment(ids: np.ndarray) -> bytes:
    """Levels, bitmaps and rank directories of some ids."""
    levels, rest = [], np.ascontiguousarray(ids, dtype="<u4")
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), dtype=np.uint8)
        padded[: len(bits)] = bits
        ranks = np.zeros(len(padded) // (BLOCK // 8), dtype="<u4")
        ranks[1:] = np.cumsum(_ONES[padded].reshape(-1, BLOCK // 8).sum(axis=1))[:-1]
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), padded.tobytes(), ranks.tobytes()))
        rest = rest[more] >> 8
    head = struct.pack("<I", len(levels)) + b"".join(struct.pack("<I", level[0]) for level in levels)
    return head + b"".join(part for level in levels for part in level[1:])


class Segment:
    """Random access into a packed segment."""

    def __init__(self, data: bytes):
        (count,) = struct.unpack_from("<I", data)
        sizes = struct.unpack_from(f"<{count}I", data, 4)
        at, self.levels = 4 + 4 * count, []
        for size in sizes:
            blocks = -(-size // BLOCK)
            parts = []
            for length, kind in ((size, np.uint8), (blocks * BLOCK // 8, np.uint8), (blocks * 4, "<u4")):
                parts.append(np.frombuffer(data, dtype=kind, count=length // np.dtype(kind).itemsize, offset=at))
                at += length
            self.levels.append(parts)

    def _rank(self, level: int, position: int) -> int:
        _, bits, ranks = self.levels[level]
        if position >= len(bits) * 8:
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        first = position // BLOCK * (BLOCK // 8)
        whole = int(_ONES[bits[first : position // 8]].sum())
        return int(ranks[position // BLOCK]) + whole + int(_ONES[bits[position // 8] & ((1 << position % 8) - 1)])

    def get(self, position: int) -> int:
        """The id at a position."""
        value = 0
        for level, (codes, bits, _) in enumerate(self.levels):
            value |= int(codes[position]) << (8 * level)
            if not bits[position // 8] >> (position % 8) & 1:
                break
            position = self._rank(level, position)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids at positions ``start`` to ``end``, level by level."""
        values = np.zeros(end - start, dtype="<u4")
        where = np.arange(end - start)
        for level, (codes, bits, _) in enumerate(self.levels):
            if start >= end:
                break
            values[where] |= codes[start:end].astype("<u4") << np.uint32(8 * level)
            first = start // 8
            more = np.unpackbits(bits[first : -(-end // 8)], bitorder="little")[start - 8 * first :][: end - start]
            where = where[more.astype(bool)]
            start = self._rank(level, start) if len(where) else 0
            end = start + len(where)
        return values


class IdWriter:
    """Writes one file of ids, document by document."""

    def __init__(self, sink):
        self.sink, self.at, self.count = sink, 0, 0
        self.docs: list[tuple[int, int, int]] = []
        self.segments: list[tuple[int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        place = self.at
        self.sink.write(data)
        self.at += len(data)
        return place

    def _flush(self, least: int) -> None:
        while self.held >= least and self.held:
            ids = np.concatenate(self.waiting)
            first = self.count - self.held
            self.segments.append((first, self._put(pack_segment(ids[:SEGMENT]))))
            self.waiting, self.held = [ids[SEGMENT:]], max(0, len(ids) - SEGMENT)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((_NONE if doc_id is None else doc_id, self.count, len(ids)))
        self.waiting.append(ids)
        self.count += len(ids)
        self.held += len(ids)
        self._flush(SEGMENT)

    def close(self) -> None:
        self._flush(1)
        docs = self._put(np.array(self.docs, dtype="<i8").tobytes())
        segments = self._put(np.array(self.segments, dtype="<i8").tobytes())
        self._put(_TAIL.pack(docs, len(self.docs), segments, len(self.segments), self.count))


class IdFile:
    """Reads a file of ids through a seekable source; holds one segment at a time."""

    def __init__(self, source):
        self.source, size = source, source.size()
        docs, n_docs, segments, n_segments, self.count = _TAIL.unpack(self._read(size - _TAIL.size, _TAIL.size))
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of ids")
        self.docs = np.frombuffer(self._read(docs, 24 * n_docs), dtype="<i8").reshape(-1, 3)
        self.segments = np.frombuffer(self._read(segments, 16 * n_segments), dtype="<i8").reshape(-1, 2)
        self.ends = np.append(self.segments[1:, 1], docs)
        self.open: tuple[int, Segment | None] = (-1, None)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _segment(self, number: int) -> Segment:
        if self.open[0] != number:
            at = int(self.segments[number, 1])
            self.open = (number, Segment(self._read(at, int(self.ends[number]) - at)))
        return self.open[1]

    def get(self, position: int) -> int:
        number = int(np.searchsorted(self.segments[:, 0], position, "right")) - 1
        return self._segment(number).get(position - int(self.segments[number, 0]))

    def slice(self, start: int, end: int) -> np.ndarray:
        parts = []
        while start < end:
            number = int(np.searchsorted(self.segments[:, 0], start, "right")) - 1
            first = int(self.segments[number, 0])
            last = min(end, first + SEGMENT)
            parts.append(self._segment(number).slice(start - first, last - first))
            start = last
        return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


def write_ids(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``(doc_id, text)`` in ascending order of id; returns the manifest.

    Manifest: ``(part, file, n_docs, n_ids)``, a row per file, parts in the order of ids.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer = sink = None
        for batch in hashing.text_steps(batches):
            if writer is None:
                files, folder = fs.FileSystem.from_uri(path)
                files.create_dir(folder, recursive=True)
                name = f"ids-{part:06d}-{uuid.uuid4().hex}.dac"
                sink = files.open_output_stream(f"{folder}/{name}", compression=None)
                writer = IdWriter(sink)
            encoded = encoder(tokenizer).encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                writer.add(doc_id, np.frombuffer(ids + end, dtype="<u4"))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({
                "part": [part], "file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.count],
            })

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(write, "part long, file string, n_docs long, n_ids long")
    return store(manifest, "ids-manifest")


def read_ids(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, ids)`` of all documents, read back file by file."""
    # a row per file, so it is small next to the documents
    rows, base = [], 0
    for row in manifest.orderBy("part").collect():
        rows.append((row["file"], base))
        base += row["n_ids"]
    files = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))

    def read(batches):
        from pyarrow import fs

        store_, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store_.open_input_file(f"{folder}/{file}") as source:
                    ids, held, out = IdFile(source), 0, []
                    for doc, start, count in ids.docs.tolist():
                        out.append((None if doc == _NONE else doc, base + start, ids.slice(start, start + count).tobytes()))
                        held += 4 * count
                        if held > 2 * hashing.STEP or len(out) >= 4096:
                            yield _rows(out)
                            held, out = 0, []
                    yield _rows(out)

    return files.mapInArrow(read, "doc_id long, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
        names=["doc_id", "start", "ids"],
    )


@query("op5_token_ids")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-ids")
    manifest = write_ids(docs, path, tokenizer=tokenizer_path())
    return read_ids(spark, path, manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
