"""TF-IDF features over whole texts.

Fitting counts terms with one aggregate by term. The vocabulary it keeps has at
most ``dim`` rows, so applying it is row by row: no shuffle carries texts, tokens
or features.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import as_array
from ..session import store

#: Terms a task holds before it sends them on; rows and cells per row (a power of two) of a sketch.
HELD_TERMS = 500_000
SKETCH_ROWS, SKETCH_BITS = 4, 16
#: Tokens that a task counts at once, whatever the size of the batches it gets.
COUNTED_TOKENS = 1 << 19
#: Width of the features and document-frequency limits (shares of n).
DIM = 512
MIN_DF = 0.001
MAX_DF = 0.5
#: Fixed value: length of an encoded text.
ENCODED_LENGTH = 512
#: Encoded ids below the vocabulary: padding and unknown words.
PAD, UNKNOWN, FIRST_TERM = 0, 1, 2


def tokenize(nodes: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """``tokens`` array per row, from folded text."""
    folded = T.fold_text(nodes.select(*keep, F.col(text).alias("tokens")), "tokens")
    return folded.withColumn("tokens", T.word_tokens("tokens"))


def term_frequency(nodes: DataFrame) -> DataFrame:
    """``(node_id, term, tf)``."""
    tokens = tokenize(nodes).select("node_id", F.explode("tokens").alias("term"))
    return tokens.groupBy("node_id", "term").agg(F.count("*").alias("tf"))


def _token_slices(batches):
    """The token lists of all batches, at most ``COUNTED_TOKENS`` tokens at once; a text stays whole."""
    for batch in batches:
        tokens = batch.column("tokens")
        ends = tokens.offsets.to_numpy()[1:]
        start = 0
        while start < len(tokens):
            base = tokens.offsets[start].as_py()
            end = max(start + 1, int(np.searchsorted(ends, base + COUNTED_TOKENS, side="right")))
            yield tokens.slice(start, end - start)
            start = end


def _batch_counts(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(terms, df, total)`` of a batch of token lists, without a step per token."""
    rows = pc.list_parent_indices(tokens).to_numpy()
    coded = pc.dictionary_encode(tokens.flatten())
    codes, terms = coded.indices.to_numpy(), coded.dictionary
    pairs = np.unique(rows.astype(np.int64) * len(terms) + codes)
    size = len(terms)
    return terms, np.bincount(pairs % max(1, size), minlength=size), np.bincount(codes, minlength=size)


def _counted(tokens: DataFrame, keep=None) -> DataFrame:
    """``(term, df, total)`` from ``tokens`` arrays; ``keep(terms)`` may rule terms out before the shuffle."""

    def count(batches):
        held, rows = [], 0

        def merged():
            table = pa.Table.from_batches(held)
            sums = table.group_by("term").aggregate([("df", "sum"), ("total", "sum")])
            return pa.RecordBatch.from_arrays(
                [sums.column(c).combine_chunks() for c in ("term", "df_sum", "total_sum")], names=["term", "df", "total"]
            )

        for tokens in _token_slices(batches):
            terms, df, total = _batch_counts(tokens)
            found = pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64()), pa.array(total, pa.int64())], names=["term", "df", "total"])
            if keep is not None and found.num_rows:
                found = found.filter(pa.array(keep(terms)))
            held.append(found)
            rows += found.num_rows
            if rows > HELD_TERMS:
                some = merged()
                if some.num_rows > HELD_TERMS // 2:
                    yield some
                    held, rows = [], 0
                else:
                    held, rows = [some], some.num_rows
        if held:
            yield merged()

    partial = tokens.select("tokens").mapInArrow(count, "term string, df long, total long")
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def document_frequency(nodes: DataFrame) -> DataFrame:
    """``(term, df, total)``: documents holding a term and its total count.

    A text is one row, so its distinct terms are found in its task; a task sends each
    term once, with both counts, for the one shuffle by term.
    """
    return _counted(tokenize(nodes, keep=()))


class TermSketch:
    """Count-Min sketch of document frequencies (Cormode and Muthukrishnan, 2005).

    An estimate is never below the true count, so what it rules out is rightly out.
    """

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @staticmethod
    def places(terms: pa.Array) -> np.ndarray:
        """The cell of each term in each row of the sketch."""
        hashed = pd.util.hash_array(terms.to_numpy(zero_copy_only=False).astype(object), categorize=False)
        low, high = hashed & np.uint64(0xFFFFFFFF), (hashed >> np.uint64(32)) | np.uint64(1)
        rows = np.arange(SKETCH_ROWS, dtype=np.uint64)[:, None]
        return (((low + rows * high) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - SKETCH_BITS)).astype(np.int64)

    def estimate(self, terms: pa.Array) -> np.ndarray:
        return np.min(np.take_along_axis(self.cells, self.places(terms), axis=1), axis=0)


def term_sketch(tokens: DataFrame) -> TermSketch:
    """One sketch per task, added up in groups of tasks; a sketch has 2 MB at any size."""
    shape = (SKETCH_ROWS, 1 << SKETCH_BITS)

    def sketch(batches):
        cells = np.zeros(shape, dtype=np.int64)
        for tokens in _token_slices(batches):
            terms, df, _ = _batch_counts(tokens)
            if len(terms):
                for row, places in zip(cells, TermSketch.places(terms), strict=True):
                    np.add.at(row, places, df)
        yield pa.RecordBatch.from_pydict({"cells": [cells.tobytes()]})

    def added(batches):
        total = None
        for batch in batches:
            for one in batch.column("cells"):
                cells = np.frombuffer(one.as_buffer(), dtype=np.int64)
                total = cells.copy() if total is None else total + cells
        if total is not None:
            yield pa.RecordBatch.from_pydict({"cells": [total.tobytes()]})

    groups = max(1, int(float(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    merged = tokens.select("tokens").mapInArrow(sketch, "cells binary").repartition(groups).mapInArrow(added, "cells binary")
    found = [np.frombuffer(r["cells"], dtype=np.int64) for r in merged.collect()]
    return TermSketch(np.sum(found, axis=0).reshape(shape) if found else np.zeros(shape, dtype=np.int64))


def frequent_terms(tokens: DataFrame, least: int) -> DataFrame:
    """``document_frequency`` of the terms that at least ``least`` documents hold, by two passes.

    The first pass makes a sketch, which rules out nearly all rare terms; the second one
    counts the others exactly. Rare terms, which grow with the corpus, are never shuffled.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(term_sketch(tokens))
    counted = _counted(tokens, lambda terms: shared.value.estimate(terms) >= least)
    return counted.filter(F.col("df") >= least)


def prune_vocabulary(
    terms: DataFrame, nodes: DataFrame, *, min_df: float = MIN_DF, max_df: float = MAX_DF
) -> DataFrame:
    """Keep terms with ``min_df * n <= df <= max_df * n``; n counts all documents.

    Adds ``n``, which the weights need.
    """
    n = nodes.agg(F.count("*").alias("n")).scalar()
    return terms.withColumn("n", n).filter(
        (F.col("df") >= F.lit(min_df) * F.col("n")) & (F.col("df") <= F.lit(max_df) * F.col("n"))
    )


def top_terms(terms: DataFrame, *, dim: int = DIM) -> DataFrame:
    """The ``dim`` most frequent terms; ties go to the smaller term."""
    return terms.orderBy(F.desc("total"), "term").limit(dim)


def vocabulary_index(kept: DataFrame) -> DataFrame:
    """Add ``col``, the alphabetical position. At most ``dim`` rows come in."""
    place = F.row_number().over(Window.orderBy("term")) - 1
    return kept.withColumn("col", place)


def vocabulary(
    nodes: DataFrame, *, dim: int = DIM, min_df: float = MIN_DF, max_df: float = MAX_DF
) -> DataFrame:
    """``(term, df, total, n, col)`` for the kept terms."""
    return _vocabulary(store(tokenize(nodes, keep=()), "tokens"), dim=dim, min_df=min_df, max_df=max_df)


def _vocabulary(tokens: DataFrame, *, dim: int, min_df: float, max_df: float) -> DataFrame:
    n = tokens.count()
    frequent = frequent_terms(tokens, math.ceil(min_df * n))
    return vocabulary_index(top_terms(prune_vocabulary(frequent, tokens, min_df=min_df, max_df=max_df), dim=dim))


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary: terms in column order, their df, and the corpus size."""

    terms: tuple[str, ...]
    df: tuple[int, ...]
    n: int

    @functools.cached_property
    def idf(self) -> list[float]:
        return [math.log((1 + self.n) / (1 + df)) + 1 for df in self.df]

    def counts(self, nodes: DataFrame, *, vec: str = "tf") -> DataFrame:
        """``(node_id, tf)``: counts of the kept terms as a sparse vector."""
        counter = CountVectorizerModel.from_vocabulary(
            list(self.terms), inputCol="tokens", outputCol=vec
        )
        tokens = nodes if "tokens" in nodes.columns else tokenize(nodes)
        return counter.transform(tokens.select("node_id", "tokens")).drop("tokens")

    def weighted(self, nodes: DataFrame) -> DataFrame:
        """``(node_id, vec)``: counts times idf, sparse, not normalised."""
        weigh = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="tf", outputCol="vec"
        )
        return weigh.transform(self.counts(nodes)).drop("tf")

    def vectors(self, nodes: DataFrame, *, to_sparse: bool = True) -> DataFrame:
        """``(node_id, vec)`` of unit length; a text without kept terms is zero."""
        unit = Normalizer(p=2.0, inputCol="_vec", outputCol="vec")
        rows = unit.transform(self.weighted(nodes).withColumnRenamed("vec", "_vec")).drop("_vec")
        if to_sparse:
            return rows
        return rows.withColumn("vec", vector_to_array("vec"))

    def long(self, rows: DataFrame, vec: str = "vec") -> DataFrame:
        """Non-zero entries as ``(node_id, term, value)``."""
        names = F.split(F.lit(" ".join(self.terms)), " ")
        return (
            rows.select("node_id", F.posexplode(as_array(rows, vec)).alias("_i", "value"))
            .filter(F.col("value") != 0)
            .select("node_id", F.element_at(names, F.col("_i") + 1).alias("term"), "value")
        )

    def encode(self, nodes: DataFrame, *, length: int = ENCODED_LENGTH) -> DataFrame:
        """Token ids cut or padded to ``length``, with a 0/1 mask."""
        pairs = " ".join(f"{term}:{i + FIRST_TERM}" for i, term in enumerate(self.terms))
        ids = F.str_to_map(F.lit(pairs), F.lit(" "), F.lit(":"))
        known = F.transform(
            F.slice("tokens", 1, length),
            lambda t: F.coalesce(F.element_at(ids, t).cast("int"), F.lit(UNKNOWN)),
        )
        size = F.least(F.size("tokens"), F.lit(length))
        padding = F.array_repeat(F.lit(PAD), F.lit(length) - size)
        return tokenize(nodes).select(
            "node_id",
            F.concat(known, padding).alias("input_ids"),
            F.concat(
                F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), F.lit(length) - size)
            ).alias("attention_mask"),
        )


def fit_tfidf(
    nodes: DataFrame, *, dim: int = DIM, min_df: float = MIN_DF, max_df: float = MAX_DF
) -> TfidfModel:
    """Fit on all texts, or on ``tokens`` arrays. Only the kept terms (at most ``dim`` rows) reach the driver."""
    tokens = nodes if "tokens" in nodes.columns else store(tokenize(nodes, keep=()), "tokens")
    rows = _vocabulary(tokens, dim=dim, min_df=min_df, max_df=max_df).orderBy("col").collect()
    if not rows:
        raise ValueError("no term is left: loosen min_df or max_df")
    return TfidfModel(
        tuple(r["term"] for r in rows), tuple(r["df"] for r in rows), rows[0]["n"]
    )


def vectorize_texts(
    nodes: DataFrame,
    *,
    dim: int = DIM,
    min_df: float = MIN_DF,
    max_df: float = MAX_DF,
    to_sparse: bool = True,
) -> DataFrame:
    """Fit and apply: ``(node_id, vec)``. Texts are cut into words once, and these are stored."""
    tokens = store(tokenize(nodes), "tokens")
    return fit_tfidf(tokens, dim=dim, min_df=min_df, max_df=max_df).vectors(tokens, to_sparse=to_sparse)


def l2_normalize_long(features: DataFrame) -> DataFrame:
    """Unit length for features in long form ``(node_id, dim, value)``.

    A node has at most one row per feature, so its window is bounded by the width.
    """
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("node_id")))
    return features.withColumn("_norm", norm).withColumn(
        "value", F.when(F.col("_norm") > 0, F.col("value") / F.col("_norm")).otherwise(F.col("value"))
    ).drop("_norm")
