"""Operator 12: exact top-k inner products from a bit-sliced index of quantised vectors.

A component becomes ``floor(scale * x)``. The index holds blocks of rows, sorted by id.
In a block, each component less its smallest value is cut into bit slices: one bitmap of
rows per binary digit (O'Neil and Quass, "Improved query performance with variant
indexes", 1997). The score of a query is a sum of slices shifted by the digits of the
query's components; a negative component takes the complement of the slices and a
constant. Slices of equal weight are added three to two (carry-save), until one bitmap
per digit of the score is left. The rows with the highest scores are then chosen from
the most significant bitmap down; rows that tie at the boundary are taken by id. Scores
of the chosen rows are read off the bitmaps, so nothing is approximate.

Queries are taken in blocks of bounded size, each broadcast to all index blocks in a job
of its own: every query meets every row, no pair of rows is ever shuffled. A task keeps
the best ``k`` per query over its blocks, and these are merged by a window per query.

Defined cases: rows with a null id, a null vector, or a null or non-finite component
take no part; vectors may differ in length, what one lacks counts as zero (an empty
vector scores 0 with all); rows of the query's id are not its candidates; repeated rows
are candidates, and queries, each; fewer candidates give fewer ranks; an empty table
gives no rows; other columns are not read. A score that may pass 2**62 is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .registry import query, table

SCALE = 256
#: Bounds of a block of the index: rows, and rows times components.
BLOCK_ROWS = 16_384
BLOCK_CELLS = 1 << 22
#: Bounds of a block of queries, which is broadcast: rows, and rows times components.
QUERY_ROWS = 4096
QUERY_CELLS = 1 << 20

INDEX = "ids binary, lows binary, widths binary, slices binary"


def usable(vectors: DataFrame, id: str, vec: str) -> DataFrame:
    """``(id, vec)`` of the rows that take part."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(
        F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("vec")
    ).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite.eqNullSafe(True))


def quantised(batch, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, components)`` of a record batch; short vectors are filled up with zeros."""
    lists = batch.column("vec")
    sizes = np.diff(lists.offsets.to_numpy())
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
    if len(values) and np.abs(values).max() >= 2.0**62:
        raise ValueError("a quantised component does not fit 62 bits")
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values.astype(np.int64)
    return batch.column("id").to_numpy(), out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(part.shape[1] for part in parts)
    return np.concatenate([np.pad(part, ((0, 0), (0, width - part.shape[1]))) for part in parts])


def packed(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of 64-bit words from 0/1 rows."""
    count = bits.shape[-1]
    tail = [(0, 0)] * (bits.ndim - 1) + [(0, -count % 64)]
    return np.packbits(np.pad(bits.astype(np.uint8), tail), axis=-1, bitorder="little").view("<u8")


def slice_block(ids: np.ndarray, components: np.ndarray) -> dict[str, bytes]:
    """One row of the index."""
    order = np.argsort(ids, kind="stable")
    components = components[order]
    lows = components.min(axis=0)
    above = (components - lows).astype(np.uint64)
    widths = np.array([int(top).bit_length() for top in above.max(axis=0)], dtype=np.uint8)
    slices = [packed((above[:, i] >> np.arange(w, dtype=np.uint64)[:, None]) & np.uint64(1)) for i, w in enumerate(widths) if w]
    return {
        "ids": ids[order].astype("<i8").tobytes(), "lows": lows.astype("<i8").tobytes(),
        "widths": widths.tobytes(), "slices": b"".join(x.tobytes() for x in slices),
    }


def build_index(
    vectors: DataFrame, *, id: str = "vec_id", vec: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The stored index: one row per block of rows of a task; every usable row is in one."""

    def apply(batches):
        ids, parts, cells = [], [], 0
        for batch in batches:
            keys, values = quantised(batch, scale)
            step = max(1, min(block_rows, BLOCK_CELLS // max(1, values.shape[1])))
            for at in range(0, len(keys), step):
                ids.append(keys[at : at + step])
                parts.append(values[at : at + step])
                if sum(map(len, ids)) >= block_rows or sum(x.size for x in parts) >= BLOCK_CELLS:
                    yield pa.RecordBatch.from_pylist([slice_block(np.concatenate(ids), _stacked(parts))])
                    ids, parts = [], []
        if ids and len(np.concatenate(ids)):
            yield pa.RecordBatch.from_pylist([slice_block(np.concatenate(ids), _stacked(parts))])

    path = scratch_path(vectors.sparkSession, "bit-sliced-index")
    # not compressed: the size of a file bounds what a task reads at once
    usable(vectors, id, vec).mapInArrow(apply, INDEX).write.option("compression", "uncompressed").parquet(path)
    return vectors.sparkSession.read.schema(INDEX).parquet(path)


class Block:
    """A block of the index, ready for queries."""

    def __init__(self, row: dict[str, bytes]):
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.lows = np.frombuffer(row["lows"], dtype="<i8")
        self.widths = np.frombuffer(row["widths"], dtype=np.uint8).astype(np.int64)
        self.words = -(-len(self.ids) // 64)
        slices = np.frombuffer(row["slices"], dtype="<u8").reshape(-1, self.words)
        #: All slices, then their complements.
        self.slices = np.concatenate([slices, ~slices])
        self.component = np.repeat(np.arange(len(self.widths)), self.widths)
        self.digit = np.arange(len(slices)) - np.repeat(np.cumsum(self.widths) - self.widths, self.widths)
        self.all = packed(np.ones(len(self.ids)))

    def add(self, weights: list[int]) -> tuple[int, np.ndarray]:
        """``(constant, bitmaps)``: a row's score is the constant and its bits, least first."""
        weights = (weights + [0] * len(self.widths))[: len(self.widths)]
        sizes = np.array([abs(x) for x in weights], dtype=np.int64)
        negative = np.array([x < 0 for x in weights], dtype=bool)
        tops = [(1 << int(w)) - 1 for w in self.widths]
        if sum(abs(q) * (top + abs(int(low))) for q, top, low in zip(weights, tops, self.lows, strict=True)) >= 1 << 62:
            raise ValueError("a score may not fit 62 bits")
        constant = sum(q * int(low) for q, low in zip(weights, self.lows, strict=True)) + sum(
            q * top for q, top in zip(weights, tops, strict=True) if q < 0
        )
        places, digits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for shift in range(int(sizes.max(initial=0)).bit_length()):
            used = np.flatnonzero(((sizes >> shift) & 1)[self.component])
            places.append(used + negative[self.component[used]] * len(self.component))
            digits.append(self.digit[used] + shift)
        places, digits = np.concatenate(places), np.concatenate(digits)
        order = np.argsort(digits, kind="stable")
        places = places[order]
        bounds = np.searchsorted(digits[order], np.arange(digits.max(initial=-1) + 2))
        sums, carries, digit = [], [], 0
        while digit < len(bounds) - 1 or carries:
            if digit < len(bounds) - 1:
                carries.append(self.slices[places[bounds[digit] : bounds[digit + 1]]])
            left, carries = np.concatenate(carries), []
            while len(left) > 2:  # three bitmaps of a digit become one of it and one of the next
                third = len(left) // 3
                a, b, c = left[:third], left[third : 2 * third], left[2 * third : 3 * third]
                differs = a ^ b
                carries.append((a & b) | (differs & c))
                left = np.concatenate([differs ^ c, left[3 * third :]])
            if len(left) == 2:
                carries.append(left[:1] & left[1:])
                left = left[:1] ^ left[1:]
            sums.append(left if len(left) else np.zeros((1, self.words), dtype="<u8"))
            digit += 1
        return constant, np.concatenate(sums) if sums else np.zeros((0, self.words), dtype="<u8")

    def best(self, query_id: int, weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, scores)`` of the ``k`` best rows, ties to smaller ids."""
        constant, bits = self.add(weights)
        open_rows = self.all
        own = [np.searchsorted(self.ids, query_id, side) for side in ("left", "right")]
        if own[0] < own[1]:
            others = np.ones(len(self.ids))
            others[own[0] : own[1]] = 0
            open_rows = packed(others)
        sure = np.zeros_like(open_rows)
        for bitmap in bits[::-1]:
            high = open_rows & bitmap
            count = int(np.bitwise_count(sure | high).sum())
            if count > k:
                open_rows = high
            else:
                sure, open_rows = sure | high, open_rows & ~bitmap
                if count == k:
                    break
        chosen = self._rows(sure)
        if len(chosen) < k:  # the rows still open tie; they are in the order of ids
            chosen = np.concatenate([chosen, self._rows(open_rows)[: k - len(chosen)]])
        digits = (bits[:, chosen >> 6] >> (chosen & 63).astype(np.uint64)) & np.uint64(1)
        scores = constant + (digits.astype(np.int64) << np.arange(len(bits))[:, None]).sum(axis=0)
        return self.ids[chosen], scores

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _query_blocks(queries: DataFrame, path: str) -> list[str]:
    """Write the queries as files of bounded size; their paths."""
    size = queries.agg(F.count("*").alias("rows"), F.max(F.size("vec")).alias("width")).first()
    rows = max(1, min(QUERY_ROWS, QUERY_CELLS // max(1, size["width"] or 0)))
    spark = queries.sparkSession
    (queries.repartition(max(1, -(-size["rows"] // rows))).write.option("maxRecordsPerFile", rows).parquet(path))
    stored = spark.read.schema(queries.schema).parquet(path)
    return sorted(row["file"] for row in stored.select(F.input_file_name().alias("file")).distinct().collect())


def top_k(
    index: DataFrame, queries: DataFrame, *, k: int = 5, id: str = "vec_id", vec: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of the index for each query row."""
    spark = index.sparkSession
    wanted, found = usable(queries, id, vec), scratch_path(spark, "top-k")
    schema = "query_no string, query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(found)

    def search(batches, block, name):
        asked = block.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        for batch in batches:
            for row in batch.to_pylist():
                part = Block(row)
                for i, (query_id, weights) in enumerate(asked):
                    ids, scores = (np.concatenate(x) for x in zip(best[i], part.best(query_id, weights, k), strict=True))
                    order = np.lexsort((ids, -scores))[:k]
                    best[i] = ids[order], scores[order]
        counts = [len(ids) for ids, _ in best]
        if sum(counts):
            number = np.repeat(np.arange(len(asked)), counts)
            yield pa.RecordBatch.from_pydict({
                "query_no": pa.array([f"{name}-{i}" for i in number.tolist()], pa.string()),
                "query_id": pa.array(np.array([x[0] for x in asked], dtype=np.int64)[number]),
                "vec_id": pa.array(np.concatenate([ids for ids, _ in best])),
                "score": pa.array(np.concatenate([scores for _, scores in best])),
            })

    for number, file in enumerate(_query_blocks(wanted, scratch_path(spark, "queries"))):
        asked = []
        for batch in spark.read.schema(wanted.schema).parquet(file).toArrow().combine_chunks().to_batches():
            ids, values = quantised(batch, scale)
            asked += list(zip(ids.tolist(), values.tolist(), strict=True))
        block = spark.sparkContext.broadcast(asked)
        index.mapInArrow(lambda batches, block=block, name=number: search(batches, block, name), schema).write.mode(
            "append"
        ).parquet(found)
        block.destroy()
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return (
        spark.read.schema(schema).parquet(found).withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


TOP_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as c from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.vec_id as query_id, o.vec_id,
    coalesce(list_sum(list_transform(list_zip(q.c, o.c), lambda z: z[1] * z[2])), 0)::bigint as score
  from v q join v o on q.vec_id <> o.vec_id where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from p)
where rank <= 5
"""


@query("op12_exact_topk", TOP_SQL)
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(build_index(vectors), vectors.filter(F.col("vec_id") % 50 == 0))
