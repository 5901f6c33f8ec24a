"""Arithmetic on vectors held as ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many weights a linear map is a native expression; beyond it, Arrow + BLAS.
NATIVE_WEIGHTS = 1024


@dataclass(frozen=True)
class Linear:
    """A trained linear map ``y = W x + b``: ``weight`` is out x in."""

    weight: np.ndarray
    bias: np.ndarray | None = None

    @property
    def n_in(self) -> int:
        return self.weight.shape[1]

    @property
    def n_out(self) -> int:
        return self.weight.shape[0]

    def without_bias(self) -> "Linear":
        return Linear(self.weight)


def read_linears(weights: DataFrame) -> dict[str, Linear]:
    """Read ``weights(layer, out, in, value)`` into linear maps, one per layer.

    A null ``in`` marks the bias of output ``out``. The size of such a table is set by
    the shapes of the model, not by the data.
    """
    cells = weights.select("layer", "out", "in", "value").toPandas()
    layers = {}
    for name, part in cells.groupby("layer"):
        body, bias = part[part["in"].notna()], part[part["in"].isna()]
        shape = (int(part["out"].max()) + 1, int(body["in"].max()) + 1)
        matrix = np.zeros(shape)
        matrix[body["out"].astype(int), body["in"].astype(int)] = body["value"]
        offset = None
        if len(bias):
            offset = np.zeros(shape[0])
            offset[bias["out"].astype(int)] = bias["value"]
        layers[str(name)] = Linear(matrix, offset)
    return layers


def is_ml_vector(df: DataFrame, vec: str = "vec") -> bool:
    return isinstance(df.schema[vec].dataType, VectorUDT)


def as_array(df: DataFrame, vec: str = "vec") -> Column:
    """The vector column as ``ARRAY<DOUBLE>``, whatever form it is stored in."""
    return vector_to_array(vec) if is_ml_vector(df, vec) else F.col(vec).cast("array<double>")


def as_ml_vector(df: DataFrame, vec: str = "vec") -> Column:
    """The vector column as an ML vector; a sparse one stays sparse."""
    return F.col(vec) if is_ml_vector(df, vec) else array_to_vector(vec)


def constant(values: np.ndarray) -> Column:
    """A literal array of doubles, nested for a matrix."""
    return F.expr(_array_sql(values))


def _array_sql(values: np.ndarray) -> str:
    # one parsed expression instead of one call per number keeps planning short
    if np.ndim(values) > 1:
        return "array(" + ", ".join(_array_sql(row) for row in values) + ")"
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )


def add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)


def scale(vec: Column, factor: Column) -> Column:
    return F.transform(vec, lambda x: x * factor)


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def relu(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.greatest(x, F.lit(0.0)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda runs per element and would recompute any expression it closes over;
    binding the value as a lambda variable of a one-element array prevents that.
    """
    return F.transform(F.array(value), body)[0]


def log_softmax(vec: Column) -> Column:
    """``x - max - ln(sum(exp(x - max)))``."""

    def shift(v: Column, peak: Column) -> Column:
        mass = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - peak))
        return let(peak + F.ln(mass), lambda level: F.transform(v, lambda x: x - level))

    return let(vec, lambda v: let(F.array_max(v), lambda peak: shift(v, peak)))


def argmax(vec: Column) -> Column:
    """Index of the largest entry, the first one on ties."""
    return (F.array_position(vec, F.array_max(vec)) - 1).cast("int")


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == label).cast("double"))


def l2_normalize(vec: Column) -> Column:
    """Divide by the Euclidean norm; a zero vector stays zero."""

    def divide(v: Column, norm: Column) -> Column:
        return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)

    return let(vec, lambda v: let(F.sqrt(dot(v, v)), lambda norm: divide(v, norm)))


def linear(vec: Column, layer: Linear, *, native: bool | None = None) -> Column:
    """Apply a linear map to a vector column.

    Narrow maps stay native. Wide ones go through Arrow batches and one matrix
    product per batch, with the weights shipped inside the function.
    """
    if native is None:
        native = layer.weight.size <= NATIVE_WEIGHTS
    if not native:
        return _linear_batched(layer)(vec)
    rows = constant(layer.weight)
    product = let(vec, lambda v: F.transform(rows, lambda row: dot(row, v)))
    return product if layer.bias is None else add(product, constant(layer.bias))


def _linear_batched(layer: Linear):
    weight, bias = layer.weight, layer.bias

    @F.pandas_udf("array<double>")
    def apply(vecs: pd.Series) -> pd.Series:
        known = vecs.notna().to_numpy()
        out = np.empty(len(vecs), dtype=object)
        if known.any():
            product = np.stack(vecs[known].to_numpy()) @ weight.T
            if bias is not None:
                product = product + bias
            for place, row in zip(np.flatnonzero(known), product):
                out[place] = row
        return pd.Series(out)

    return apply
