"""Operator 6: near-duplicate vectors by cross-polytope hashing with multiprobe.

A vector is rotated by three rounds of random signs and the fast Hadamard transform; the
largest entry and its sign name the nearest corner of the cross-polytope (Andoni et al.,
"Practical and Optimal LSH for Angular Distance", 2015). A bucket joins ``rotations``
corners; a vector lies in its main bucket and probes the ones that lose least. Vectors
that meet in a bucket, one of them by its main bucket, are compared in double precision.

Equal vectors are one class first. A bucket with more than ``BLOCK`` vectors is compared
in pairs of blocks, each pair of blocks in a group of its own. A pair that meets in
several buckets counts in the first one, which both sides derive from their vectors; so
links are counted, not listed, and each task sends on the roots of its local components.

Defined cases: vectors that are null, zero, or hold null or non-finite entries link with
nothing; so do rows with a null id, which have a null component and are kept; vectors of
different length never link; rows of one id and one vector are copies of each other; an
empty table gives no rows. Bounds: ``rotations=3`` suits up to some 2**30 vectors of 64
entries; one more is due for each factor of 128.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import store
from .registry import query, table

TABLES = 10
ROTATIONS = 3
PROBES = 8
BLOCK = 1024
#: Rows compared at once; whole groups only.
CHUNK = 16384
_SEED = 20266


def hadamard(values: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis."""
    size, step = values.shape[-1], 1
    while step < size:
        split = values.reshape(*values.shape[:-1], size // (2 * step), 2, step)
        values = np.stack(
            [split[..., 0, :] + split[..., 1, :], split[..., 0, :] - split[..., 1, :]], axis=-2
        ).reshape(values.shape)
        step *= 2
    return values / np.sqrt(size)


class Polytopes:
    """Bucket names of vectors: ``codes`` has the main bucket first, then the probes."""

    def __init__(self, tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES, choices: int = 3):
        self.tables, self.rotations, self.probes, self.choices = tables, rotations, probes, choices
        self._signs: dict[int, np.ndarray] = {}
        paths = [p for p in product(range(choices), repeat=rotations)]
        self.paths = np.array(sorted(paths, key=sum))

    def signs(self, size: int) -> np.ndarray:
        if size not in self._signs:
            draw = np.random.Generator(np.random.PCG64([_SEED, size]))
            self._signs[size] = draw.choice([-1.0, 1.0], size=(self.tables * self.rotations, 3, size))
        return self._signs[size]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Bucket names of shape ``(rows, tables, probes)`` for rows of one length."""
        rows, dims = vectors.shape
        size = 1 << max(1, (dims - 1).bit_length())
        padded = np.zeros((rows, size))
        padded[:, :dims] = vectors
        signs = self.signs(size)
        out = np.empty((rows, self.tables, self.probes), dtype=np.int64)
        choices = min(self.choices, size)
        for t in range(self.tables):
            corners, losses = [], []
            for r in range(self.rotations):
                turned = padded
                for flips in signs[t * self.rotations + r]:
                    turned = hadamard(turned * flips)
                size_ = np.abs(turned)
                best = np.argsort(-size_, axis=1, kind="stable")[:, :choices]
                values = np.take_along_axis(turned, best, 1)
                corners.append(2 * best + (values < 0))
                losses.append((np.abs(values[:, :1]) - np.abs(values)) ** 2)
            paths = self.paths[(self.paths < choices).all(axis=1)]
            loss = sum(losses[r][:, paths[:, r]] for r in range(self.rotations))
            order = np.argsort(loss, axis=1, kind="stable")[:, : self.probes]
            name = np.full(order.shape, dims * self.tables + t, dtype=np.int64)
            for r in range(self.rotations):
                chosen = paths[:, r][order]
                name = name * (2 * size) + np.take_along_axis(corners[r], chosen, 1)
            out[:, t, : order.shape[1]] = name
            out[:, t, order.shape[1] :] = name[:, :1]  # fewer corners than probes
        return out


def unit(lists: pa.Array) -> np.ndarray:
    flat = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def usable(vector: F.Column) -> F.Column:
    """Not null, not zero, all entries finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _buckets(classes: DataFrame, hasher: Polytopes) -> DataFrame:
    def hash_(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                for rows in _by_length(part):
                    codes = hasher.codes(unit(rows.column("vec")))
                    each = codes.shape[1] * codes.shape[2]
                    main = np.zeros(codes.shape, dtype=bool)
                    main[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(codes.reshape(-1)), pa.array(main.reshape(-1)),
                            *(pa.array(np.repeat(rows.column(c).to_numpy(), each)) for c in ("_a", "_b")),
                        ],
                        names=["bucket", "main", "_a", "_b"],
                    )

    return classes.select("_a", "_b", "vec").mapInArrow(
        hash_, "bucket long, main boolean, _a long, _b long"
    ).groupBy("bucket", "_a", "_b").agg(F.max("main").alias("main"))


def _by_length(batch):
    lengths = np.asarray(batch.column("vec").value_lengths())
    for length in np.unique(lengths):
        yield batch.filter(pa.array(lengths == length)) if (lengths != length).any() else batch


def local_roots(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """The smallest position each position is linked with, directly or not."""
    roots = np.arange(size)
    while True:
        least = np.minimum(roots[left], roots[right])
        new = roots.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == roots).all():
            return roots
        roots = new


def _compare(rows: pa.Table, hasher: Polytopes, threshold: float):
    """Links of a chunk of whole groups: ``(positions, summed copies, roots)``."""
    rep = rows.column("rep").to_numpy()
    key = np.stack([rows.column(c).to_numpy() for c in ("_a", "_b")], axis=1)
    bucket, low, high = (rows.column(c).to_numpy() for c in ("bucket", "low", "high"))
    block, main = rows.column("block").to_numpy(), rows.column("main").to_numpy(zero_copy_only=False)
    vectors = unit(rows.column("vec").combine_chunks())
    group = np.concatenate(([0], np.cumsum(
        (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    )))
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(group)))
    left, right = [], []
    for gap in range(1, int(min(16, sizes.max()))):  # small groups, all at once
        i = np.flatnonzero((group[gap:] == group[:-gap]) & (sizes[group[gap:]] <= 16))
        near = np.einsum("ij,ij->i", vectors[i], vectors[i + gap]) >= threshold
        left.append(i[near])
        right.append(i[near] + gap)
    for start, size in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        part = vectors[start : start + size]
        for at in range(0, size, BLOCK):
            i, j = np.nonzero(part[at : at + BLOCK] @ part.T >= threshold)
            upper = i + at < j
            left.append(start + at + i[upper])
            right.append(start + j[upper])
    i = np.concatenate(left) if left else np.zeros(0, dtype=np.int64)
    j = np.concatenate(right) if right else np.zeros(0, dtype=np.int64)
    # of two blocks, only pairs across them; both sides must not be probes
    across = (low[i] == high[i]) | (block[i] != block[j])
    i, j = i[across & (main[i] | main[j])], j[across & (main[i] | main[j])]
    used = np.unique(np.concatenate([i, j]))
    if not len(used):
        return used, used, used
    at = np.zeros(len(rep), dtype=np.int64)
    at[used] = np.arange(len(used))
    codes = hasher.codes(vectors[used])
    # of equal order on both sides: the smaller key first
    swap = (key[i, 0] > key[j, 0]) | ((key[i, 0] == key[j, 0]) & (key[i, 1] > key[j, 1]))
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    first = np.zeros(len(i), dtype=np.int64)
    open_ = np.ones(len(i), dtype=bool)
    for t in range(hasher.tables):
        a, b = codes[at[i[open_]], t], codes[at[j[open_]], t]
        ab, ba = (b == a[:, :1]).any(axis=1), (a == b[:, :1]).any(axis=1)
        where = np.flatnonzero(open_)
        first[where] = np.where(ab, a[:, 0], b[:, 0])
        open_[where[ab | ba]] = False
    counted = first == bucket[i]
    i, j = i[counted], j[counted]
    copies = rows.column("copies").to_numpy()
    sums = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
    roots = local_roots(i, j, len(rep))
    linked = np.flatnonzero(sums)
    return linked, sums[linked].astype(np.int64), roots[linked]


def vector_links(
    vectors: DataFrame, *, threshold: float = 0.95, hasher: Polytopes | None = None
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for rows ``(vec_id, embedding)``."""
    hasher = hasher or Polytopes()
    rows = vectors.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"),
    ).withColumn("_usable", usable(F.col("vec")) & F.col("vec_id").isNotNull())
    keyed = rows.withColumn("_a", F.xxhash64(F.lit(1), "vec")).withColumn("_b", F.xxhash64(F.lit(2), "vec"))
    classes = store(
        keyed.filter("_usable").groupBy("_a", "_b").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")
        ),
        "vector-classes",
    )
    buckets = store(_buckets(classes, hasher), "vector-buckets")
    full = buckets.groupBy("bucket").agg(F.count("*").alias("_n"), F.max("main").alias("_m")).filter(
        (F.col("_n") > 1) & F.col("_m")
    )
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    placed = buckets.join(full.drop("_m"), "bucket").withColumn("_blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("_a", "_b"), F.col("_blocks")).cast("int")
    ).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    compared = placed.select(
        "bucket", "_a", "_b", "main", "block",
        F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"),
    ).join(classes, ["_a", "_b"])

    def compare(batches):
        for rows in _whole_groups(batches):
            linked, sums, roots = _compare(rows, hasher, threshold)
            rep = rows.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(rows.column(c).to_numpy()[linked]) for c in ("_a", "_b", "rep")),
                    pa.array(rep[roots]), pa.array(sums),
                ],
                names=["_a", "_b", "rep", "root", "links"],
            )

    grouped = compared.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    found = store(
        grouped.mapInArrow(compare, "_a long, _b long, rep long, root long, links long")
        .groupBy("_a", "_b", "rep", "root").agg(F.sum("links").alias("links")),
        "vector-links",
    )
    counts = found.groupBy("_a", "_b").agg(F.sum("links").alias("_links"))
    edges = found.filter(F.col("rep") != F.col("root")).select(F.col("rep").alias("src"), F.col("root").alias("dst"))
    # equal ids with different vectors are one node
    inside = classes.select(F.col("rep").alias("node_id")).distinct()
    components = connected_components(inside, edges)
    known = classes.select("_a", "_b", "rep", "copies").join(counts, ["_a", "_b"], "left").join(
        components.withColumnRenamed("node_id", "rep"), "rep"
    ).select("_a", "_b", "component", (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"))
    joined = keyed.select("vec_id", "_usable", "_a", "_b").join(known, ["_a", "_b"], "left")
    component = F.when(F.col("_usable"), F.col("component")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.when(F.col("_usable"), F.col("_links")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _whole_groups(batches):
    """Tables of at most some ``CHUNK`` rows of one vector length, never cutting a group."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def ready(last: bool):
        nonlocal held, rows
        whole = pa.Table.from_batches(held)
        end = len(whole)
        if not last:
            names = [whole.column(c).to_numpy() for c in ("bucket", "low", "high")]
            differs = np.flatnonzero(np.any([x != x[-1] for x in names], axis=0))
            end = int(differs[-1]) + 1 if len(differs) else 0
        rest = whole.slice(end)
        held, rows = rest.to_batches(), len(rest)
        if end:
            part = whole.slice(0, end)
            lengths = np.asarray(part.column("vec").combine_chunks().value_lengths())
            for length in np.unique(lengths):
                yield part.filter(pa.array(lengths == length))

    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            held.append(batch.slice(start, CHUNK))
            rows += held[-1].num_rows
            if rows >= CHUNK:
                yield from ready(False)
    if rows:
        yield from ready(True)


@query("op6_embedding_neardup")
def embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))
