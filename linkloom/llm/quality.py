"""Operator 7: quality classifier on hashed word n-grams, trained by FTRL.

Features of a text are its words, lower-cased (A-Z), their shapes (runs of upper case,
lower case, digits and other letters as one sign each, punctuation as it is), pairs of
neighbouring words and of neighbouring shapes, and a sign for a word that repeats the
one before. All are hashed to ``2**bits`` indices. A score is the sigmoid of a bias
and ``SCALE`` times the mean weight of the features: a sparse dot product.

Training follows the regularised leader (McMahan et al., "Ad Click Prediction: a View
from the Trenches", 2013) with L1 and L2, over a sample of at most ``max_rows``
labelled rows: those with the smallest hash of their id. Tasks hash whole texts and send
each sample row's indices and counts to the one that trains. Scoring covers every whole
text; only the text goes to Python, other columns stay where they are.

Defined cases: null and empty texts have no features and get the score of the bias;
a label row without a label is left out, several labels of one id count as the
smallest; without labelled rows every score is 0.5; repeated documents are scored each;
a very long text is one step of a task; an empty table gives no rows; columns other than
the id and the text pass through untouched, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from . import hashing
from .registry import query, table

#: Bound of the labelled rows used for training.
MAX_ROWS = 6000
BITS = 18
SCALE = 16.0
KINDS = 5

_SHAPES = np.arange(256, dtype=np.uint8)
_SHAPES[65:91] = ord("A")
_SHAPES[97:123] = ord("a")
_SHAPES[48:58] = ord("0")
_SHAPES[128:] = 0xC3


def features(batch, column: str = "text", bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(indices, bounds)``: feature indices, ``KINDS`` per word, and where each text begins."""
    data, places = hashing.joined(batch, column)
    starts, _, plain = hashing.words(data, fold=True)
    shape = _SHAPES[data]
    shape[hashing.SPACE[data]] = 0x20
    new = np.ones(len(shape), dtype=bool)
    new[1:] = (shape[1:] != shape[:-1]) | ((shape[1:] != 0x61) & (shape[1:] != 0xC3) & (shape[1:] != 0x41))
    _, _, shapes = hashing.words(shape[new])
    bounds = np.searchsorted(starts, places)
    first = np.zeros(len(plain), dtype=bool)
    first[bounds[:-1][bounds[:-1] < len(plain)]] = True

    def pairs(values: np.ndarray) -> np.ndarray:
        before = np.where(first, np.uint64(7), np.roll(values, 1))
        return hashing.mix(before * np.uint64(3) + values)

    repeats = np.where(first, False, plain == np.roll(plain, 1))
    parts = (plain, shapes, pairs(plain), pairs(shapes), repeats.astype(np.uint64))
    out = np.empty((len(plain), KINDS), dtype=np.int64)
    for kind, values in enumerate(parts):
        mixed = hashing.mix(values + np.uint64(0x1234567 * (kind + 1)))
        out[:, kind] = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    return out.reshape(-1), bounds * KINDS


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], *, bits: int = BITS, epochs: int = 3,
    alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1,
) -> np.ndarray:
    """Weights (the last is the bias) from ``(feature indices, their counts, label)`` rows, in their order."""
    size = 2**bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    packed = []
    for index, counts, label in rows:
        value = SCALE * counts / max(1, int(counts.sum()))
        packed.append((np.append(index, size).astype(np.int32), np.append(value, 1.0), label))

    def weight(index):
        at = z[index]
        return np.where(
            np.abs(at) <= l1, 0.0, -(at - np.sign(at) * l1) / ((beta + np.sqrt(n[index])) / alpha + l2)
        )

    for _ in range(epochs):
        for index, value, label in packed:
            w = weight(index)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - sigma * w
            n[index] += g * g
    return weight(np.arange(size + 1))


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = MAX_ROWS, bits: int = BITS
) -> np.ndarray:
    """Train in one task on at most ``max_rows`` labelled documents."""
    chosen = (
        labels.filter(F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
        .withColumn("_order", F.xxhash64("doc_id"))
        .orderBy("_order", "doc_id").limit(max_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def hashed(batches):
        for batch in hashing.text_steps(batches):
            indices, bounds = features(batch, bits=bits)
            found = [np.unique(indices[a:b].astype(np.int32), return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("_order", "doc_id", "_label")), pa.array(np.diff(bounds)),
                    *(pa.array([x[i].astype("<i4").tobytes() for x in found], pa.binary()) for i in (0, 1)),
                ],
                names=["_order", "doc_id", "_label", "size", "indices", "counts"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = sample.mapInArrow(
        hashed, f"_order long, doc_id {kind}, _label int, size long, indices binary, counts binary"
    )

    def fit(batches):
        rows = []
        for batch in batches:
            for order, doc, y, size, *arrays in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                rows.append((order, doc, -size, *(np.frombuffer(x, dtype="<i4") for x in arrays), y))
        rows.sort(key=lambda row: (*row[:3], row[3].tobytes()))
        weights = train_ftrl([row[3:] for row in rows], bits=bits) if rows else np.zeros(2**bits + 1)
        yield pa.record_batch({"weights": pa.array([weights.tobytes()], pa.binary())})

    # the sample is bounded, so that one task may hold it
    trained = store(counted.repartition(1).mapInArrow(fit, "weights binary"), "quality-model")
    found = trained.first()
    return np.frombuffer(found["weights"]) if found else np.zeros(2**bits + 1)


def quality_score(spark: SparkSession, weights: np.ndarray):
    """A function from a text column to its column of scores; needs no shuffle."""
    bits = int(len(weights) - 1).bit_length() - 1
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for array in texts:
            values = [np.zeros(0)]
            for batch in hashing.text_steps([pa.RecordBatch.from_arrays([array], names=["text"])]):
                indices, bounds = features(batch, "text", bits)
                sums = np.concatenate(([0.0], np.cumsum(w[indices])))
                sizes = np.maximum(1, np.diff(bounds))
                logits = w[-1] + SCALE * (sums[bounds[1:]] - sums[bounds[:-1]]) / sizes
                values.append(1 / (1 + np.exp(-np.clip(logits, -35, 35))))
            yield pa.array(np.concatenate(values))

    return score


def score_quality(docs: DataFrame, weights: np.ndarray, *, text: str = "text", score: str = "score") -> DataFrame:
    """The documents with a column of scores."""
    return docs.withColumn(score, quality_score(docs.sparkSession, weights)(F.col(f"`{text}`")))


def held_out(doc_id) -> F.Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op7_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out("doc_id"))
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
