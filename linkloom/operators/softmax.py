"""Softmax-weighted sums per group in one pass.

The state of a group is, per head, the largest score so far, the mass of the others
relative to it and the sum they weigh. Two states merge by rescaling both to the larger
peak (Milakov and Gimelshein, "Online normalizer calculation for softmax", 2018), so a
task merges what it has, and only merged states are shuffled: a hub sends a few rows
per task. Peaks need no pass, join or aggregate of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Groups a task holds before it sends their states on.
HELD = 32_768


def combine(keys: np.ndarray, states: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray]:
    """One state per key, keys ascending; a state is peaks, masses, sums, head by head."""
    order = np.argsort(keys, kind="stable")
    keys, states = keys[order], states[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    peaks = np.maximum.reduceat(states[:, :heads], starts, axis=0)
    scale = np.exp(states[:, :heads] - peaks[group])
    rest = states[:, heads:]
    width = rest.shape[1] // heads
    # masses come first, one a head, then the entries of each head
    factors = np.concatenate([scale, np.repeat(scale, width - 1, axis=1)], axis=1)
    return keys[starts], np.concatenate([peaks, np.add.reduceat(rest * factors, starts, axis=0)], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _batch(keys: np.ndarray, key: str, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    lists = []
    for values in columns.values():
        ends = np.arange(len(keys) + 1, dtype=np.int32) * values.shape[1]
        lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).reshape(-1))))
    return pa.RecordBatch.from_arrays([pa.array(keys), *lists], names=[key, *columns])


def softmax_sums(rows: DataFrame, key: str, *, heads: int, score, finish, out: tuple[str, ...]) -> DataFrame:
    """One row per ``key`` with the columns ``out`` of arrays.

    ``score(batch, matrix)`` gives scores, factors of the mass (heads wide each) and
    vectors (a multiple of heads wide) of a record batch. ``finish(peaks, masses, sums)``
    gives the values of each of ``out`` for the groups.
    """

    def partial(batches):
        keys, states, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            scores, factors, vectors = score(batch, _matrix)
            weighted = vectors * np.repeat(factors, vectors.shape[1] // heads, axis=1)
            some, state = combine(batch.column(key).to_numpy(), np.concatenate([scores, factors, weighted], axis=1), heads)
            keys.append(some)
            states.append(state)
            held += len(some)
            if held > HELD:
                some, state = combine(np.concatenate(keys), np.concatenate(states), heads)
                if len(some) > HELD // 2:
                    yield _batch(some, key, {"state": state})
                    keys, states, held = [], [], 0
                else:
                    keys, states, held = [some], [state], len(some)
        if held:
            some, state = combine(np.concatenate(keys), np.concatenate(states), heads)
            yield _batch(some, key, {"state": state})

    def finished(keys, states):
        peaks, masses, sums = states[:, :heads], states[:, heads : 2 * heads], states[:, 2 * heads :]
        return _batch(keys, key, dict(zip(out, finish(peaks, masses, sums), strict=True)))

    def merge(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, states = batch.column(key).to_numpy(), _matrix(batch.column("state"))
            if last is not None:
                keys, states = np.concatenate([last[0], keys]), np.concatenate([last[1], states])
            keys, states = combine(keys, states, heads)
            last = keys[-1:], states[-1:]  # its group may go on in the next batch
            if len(keys) > 1:
                yield finished(keys[:-1], states[:-1])
        if last is not None:
            yield finished(*last)

    kinds = ", ".join(f"{name} array<double>" for name in out)
    merged = rows.mapInArrow(partial, f"{key} bigint, state array<double>")
    return merged.repartition(key).sortWithinPartitions(key).mapInArrow(merge, f"{key} bigint, {kinds}")
