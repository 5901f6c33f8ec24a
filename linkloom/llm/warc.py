"""Operator 1: WARC files and their normaliser.

``write_archives`` lets Spark's text writer make monolithic gzip archives: a file is one
stream, as many tools leave them. ``normalise`` inflates such a stream once (Spark's text
reader does it, piece by piece), puts records together by their Content-Length, rewrites
each as a gzip member of its own, and keeps a sidecar index ``(file, offset, size)``.
``read_records`` then reads any record by seeking.

Equal payloads (by SHA-1) are stored once: the record with the largest id is the
response, the others are revisits that name it. Rewritten files carry the name of the
attempt; the index, committed by Spark, names those that count.

Defined cases: a null payload is empty; a null id is written as an empty name and is
never the one referred to unless all its copies have null ids, which are then all
responses; repeated rows with the largest id are all responses; a null URL becomes the
record's name; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import hot_keys, lookup_join
from ..session import scratch_path, store
from .registry import query, table

GAP = "\r\n\r\n"
NAME = "urn:page:"
#: Duplicate groups joined by broadcast (some 60 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 200_000
#: Bytes of an archive that one task reads back.
BLOCK = 16 << 20


def base32_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four base32 digits."""
    digest = F.sha1(payload.cast("binary"))
    parts = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    # fixed values: digits of radix 32 and the base32 alphabet
    return F.translate(
        F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def with_revisits(pages: DataFrame, *, min_bytes: int = 0, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Pages with ``digest`` and ``refers_to`` (null for responses)."""
    rows = pages.select(
        F.col("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("payload")
    ).withColumn("digest", base32_digest(F.col("payload")))
    heads = store(
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest").agg(F.max("page_id").alias("_head"), F.count("*").alias("_n"))
        .filter((F.col("_n") > 1) & F.col("_head").isNotNull())
        .select(F.col("digest").alias("_digest"), "_head"),
        "payload-groups",
    )
    if heads.count() <= broadcast_groups:
        joined = rows.join(F.broadcast(heads), F.col("digest") == F.col("_digest"), "left")
    else:
        hot = hot_keys(rows.select("digest"), "digest", min_rows=100_000)["digest"]
        joined = lookup_join(rows, heads, "digest", "_digest", hot=hot, how="left")
    other = F.col("_head").isNotNull() & ~F.col("_head").eqNullSafe(F.col("page_id"))
    return joined.withColumn("refers_to", F.when(other, F.col("_head"))).drop("_digest", "_head")


def record_text(date: str = "1970-01-01T00:00:00Z") -> Column:
    """One record; the gap after it is the line separator of the writer."""
    revisit = F.col("refers_to").isNotNull()
    name = F.concat(F.lit(f"<{NAME}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    address = F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.regexp_replace(name, "[<>]", ""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"), F.lit(GAP),
    )
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), address,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                F.lit(f"\r\nWARC-Refers-To: <{NAME}"), F.col("refers_to").cast("string"), F.lit(">"),
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit(GAP), body,
    )


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Write a record per page into monolithic gzip archives."""
    rows = with_revisits(pages, **options).select(record_text().alias("value"))
    rows.write.option("lineSep", GAP).option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip")


def split_records(pieces) -> object:
    """Whole records out of the pieces of one stream that ``GAP`` separates."""
    gap = GAP.encode()
    held, need = bytearray(), 0
    for piece in pieces:
        held += piece
        held += gap
        while len(held) >= max(need, 1):
            head = held.find(gap)
            if head < 0:
                break
            need = head + 8 + int(_fields(bytes(held[:head]))[b"content-length"])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip(b"\r\n"):
        raise ValueError("an archive ends inside a record")


def _fields(head: bytes) -> dict[bytes, bytes]:
    lines = head.split(b"\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}


def normalise(spark: SparkSession, archives: str, path: str, *, level: int = 4) -> DataFrame:
    """Rewrite every record as its own member; returns the stored index ``(file, offset, size)``."""
    pieces = spark.read.option("lineSep", GAP).text(archives).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").cast("binary").alias("piece")
    )

    def rewrite(batches):
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        for _, stream in _by_source(batches):
            name = f"{uuid.uuid4().hex}.warc.gz"
            offsets, sizes, at = [], [], 0
            with files.open_output_stream(f"{folder}/{name}", compression=None) as sink:
                for record in split_records(stream):
                    member = zlib.compressobj(level, wbits=31)
                    data = member.compress(record) + member.flush()
                    sink.write(data)
                    offsets.append(at)
                    sizes.append(len(data))
                    at += len(data)
            yield pa.RecordBatch.from_pydict(
                {"file": [name] * len(offsets), "offset": offsets, "size": sizes},
                schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64())]),
            )

    return store(pieces.mapInArrow(rewrite, "file string, offset long, size long"), "warc-index")


def _by_source(batches):
    """``(source, pieces)`` for each file, one after the other, without holding a file."""
    rows = (
        row for batch in batches
        for row in zip(batch.column("source").to_pylist(), batch.column("piece").to_pylist(), strict=True)
    )
    row = next(rows, None)
    while row is not None:
        source = row[0]

        def stream():
            nonlocal row
            while row is not None and row[0] == source:
                yield row[1]
                row = next(rows, None)

        pieces = stream()
        yield source, pieces
        for _ in pieces:
            pass


RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def read_records(index: DataFrame, path: str, *, payloads: bool = True) -> DataFrame:
    """Records by their places; the digest of a response is computed and compared."""

    def page(name: bytes | None) -> int | None:
        text = (name or b"").strip(b"<>").removeprefix(NAME.encode())
        return int(text) if text else None

    def parse(record: bytes) -> tuple:
        head, _, rest = record.partition(GAP.encode())
        fields = _fields(head)
        http, _, payload = rest[: int(fields[b"content-length"])].partition(GAP.encode())
        size = int(_fields(http)[b"content-length"])
        digest = fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
        kind = fields[b"warc-type"].decode()
        if kind == "response" and (
            len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
        ):
            raise ValueError(f"damaged record {fields[b'warc-record-id']!r}")
        return (
            page(fields[b"warc-record-id"]), fields[b"warc-target-uri"].decode(), size, digest, kind,
            page(fields.get(b"warc-refers-to")), payload if payloads else None,
        )

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [field.split()[0] for field in RECORDS.split(", ")]

    def rows(found):
        columns = list(zip(*found, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names=names
        )

    def read(batches):
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path)
        name, source = None, None
        for batch in batches:
            found, held = [], 0
            for file, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size")), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, files.open_input_file(f"{folder}/{file}")
                source.seek(offset)
                record = zlib.decompress(source.read(size), wbits=31)
                found.append(parse(record))
                held += len(record) if payloads else 0
                if held > 4 << 20:
                    yield rows(found)
                    found, held = [], 0
            yield rows(found)

    tasks = (index.agg(F.sum("size")).first()[0] or 0) // BLOCK + 1
    placed = index.repartition(tasks, "file", F.floor(F.col("offset") / BLOCK)).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(read, RECORDS)


@query("op1_warc_normaliser")
def warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, path = scratch_path(spark, "warc-archives"), scratch_path(spark, "warc-members")
    write_archives(table(spark, sf_dir, "pages"), archives, min_bytes=0)
    index = normalise(spark, archives, path)
    return read_records(index, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
