"""Classifiers for several seeded splits, learnt together.

All seeds read the same feature rows and differ in which of them they train on. Each seed
has its own minimiser (L-BFGS, Liu and Nocedal 1989) on the driver, which asks for the
loss and gradient at a point; the questions of all seeds are answered by one pass over the
rows. Sums are made per task, then per group of tasks, so the driver gets a few rows.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_array
from ..session import settle
from .ordering import split_many

#: Steps that L-BFGS remembers, and how often a step may be halved.
MEMORY, HALVINGS = 10, 20


def lbfgs(start: np.ndarray, *, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, float]]:
    """Yields points, is sent their loss and gradient; returns the minimum of a convex loss and the largest gradient there."""
    x = start
    loss, gradient = yield x
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(gradient).max() <= tol:
            break
        direction, factors = gradient.copy(), []
        for s, y in reversed(steps):
            factor = s @ direction / (s @ y)
            factors.append(factor)
            direction -= factor * y
        if steps:
            s, y = steps[-1]
            direction *= s @ y / (y @ y)
        for (s, y), factor in zip(steps, reversed(factors), strict=True):
            direction += s * (factor - y @ direction / (s @ y))
        slope = gradient @ direction
        size = 1.0 if steps else min(1.0, 1.0 / np.abs(gradient).sum())
        for _ in range(HALVINGS):
            point = x - size * direction
            new_loss, new_gradient = yield point
            if new_loss <= loss - 1e-4 * size * slope:
                break
            size /= 2
        else:  # no step makes the loss smaller: rounding is reached
            break
        s, y = point - x, new_gradient - gradient
        if s @ y > 1e-14 * (y @ y):
            steps = [*steps, (s, y)][-MEMORY:]
        x, loss, gradient = point, new_loss, new_gradient
    return x, float(np.abs(gradient).max())


def _answers(rows: DataFrame, points: dict[int, np.ndarray], classes: int, width: int) -> dict[int, np.ndarray]:
    """Per seed: summed loss, then summed gradient, at its point; one pass over the rows."""
    seeds = sorted(points)
    weights = np.concatenate([points[s].reshape(classes, width + 1) for s in seeds])
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def sums(batches):
        total = np.zeros((len(seeds), 1 + classes * (width + 1)))
        w = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vec").flatten().to_numpy().reshape(-1, width)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            label, trains = batch.column("label").to_numpy(), batch.column("trains").to_numpy()
            scores = (x @ w.T).reshape(len(x), len(seeds), classes)
            scores -= scores.max(axis=2, keepdims=True)
            mass = np.log(np.exp(scores).sum(axis=2, keepdims=True))
            taught = ((trains[:, None] >> np.array(seeds)) & 1).astype(float)
            own = scores[np.arange(len(x)), :, label] - mass[:, :, 0]
            wrong = np.exp(scores - mass)
            wrong[np.arange(len(x)), :, label] -= 1
            wrong *= taught[:, :, None]
            total[:, 0] -= (own * taught).sum(axis=0)
            total[:, 1:] += (wrong.reshape(len(x), -1).T @ x).reshape(len(seeds), -1)
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    def added(batches):
        parts = [np.frombuffer(x) for batch in batches for x in batch.column("sums").to_pylist()]
        if parts:
            yield pa.RecordBatch.from_pydict({"sums": [np.sum(parts, axis=0).tobytes()]})

    per_task = rows.select("label", "vec", "trains").mapInArrow(sums, "sums binary")
    groups = max(1, int(float(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    found = [np.frombuffer(r["sums"]) for r in per_task.repartition(groups).mapInArrow(added, "sums binary").collect()]
    shared.destroy()
    total = np.sum(found, axis=0).reshape(len(seeds), -1) if found else np.zeros((len(seeds), 1 + classes * (width + 1)))
    return dict(zip(seeds, total, strict=True))


@dataclass(frozen=True)
class SeedModels:
    """Per seed: classes x (width + 1) weights (the last column is the bias) and the largest gradient."""

    weights: dict[int, np.ndarray]
    gradients: dict[int, float]
    passes: int
    #: ``(node_id, label, vec, trains)``; bit ``s`` of ``trains`` says that seed ``s`` trains on the row.
    rows: DataFrame


def train_seeds(
    nodes: DataFrame, vectors: DataFrame, *, seeds: range = range(1, 11), classes: int,
    reg: float = 0.001, max_iter: int = 100, tol: float = 1e-7,
) -> SeedModels:
    """Multinomial logistic regression for the exact split of each seed.

    ``nodes`` is ``(node_id, label)``, labels 0 to ``classes - 1``; seeds are 0 to 62. The
    loss is the mean over the train rows plus ``reg / 2`` times the squared weights (not
    of the bias). Models equal those fitted one by one.
    """
    if min(seeds) < 0 or max(seeds) > 62:
        raise ValueError("seeds are 0 to 62")
    bit = F.when(F.col("mode") == "train", F.expr("shiftleft(1L, seed)")).otherwise(0)
    taught = split_many(nodes, seeds=seeds).groupBy("node_id").agg(F.sum(bit).alias("trains"))
    rows = settle(
        nodes.select("node_id", F.col("label").cast("long").alias("label")).join(taught, "node_id")
        .join(vectors.select("node_id", as_array(vectors).alias("vec")), "node_id")
    )
    first = rows.select(F.size("vec").alias("width")).first()
    width = first["width"] if first else 0
    sizes = rows.agg(*[F.sum(F.expr(f"shiftright(trains, {s}) & 1")).alias(f"s{s}") for s in seeds]).first()
    counts = {s: max(1, sizes[f"s{s}"] or 0) for s in seeds}
    decay = np.full((classes, width + 1), reg)
    decay[:, -1] = 0
    decay = decay.reshape(-1)
    running = {s: lbfgs(np.zeros(decay.size), max_iter=max_iter, tol=tol) for s in seeds}
    points = {s: next(run) for s, run in running.items()}
    weights, gradients, passes = {}, {}, 0
    while points:
        passes += 1
        answers = _answers(rows, points, classes, width)
        following = {}
        for s, point in points.items():
            loss = answers[s][0] / counts[s] + 0.5 * decay @ point**2
            gradient = answers[s][1:] / counts[s] + decay * point
            try:
                following[s] = running[s].send((loss, gradient))
            except StopIteration as end:
                found, gradients[s] = end.value
                weights[s] = found.reshape(classes, width + 1)
        points = following
    return SeedModels(weights, gradients, passes, rows)


def predict_seeds(models: SeedModels) -> DataFrame:
    """``(seed, node_id, label, pred)`` of all rows and seeds, from one pass; the first class on ties."""
    seeds = sorted(models.weights)
    shared = models.rows.sparkSession.sparkContext.broadcast(np.concatenate([models.weights[s] for s in seeds]))

    def predict(batches):
        w = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1)
            scores = (x @ w[:, :-1].T + w[:, -1]).reshape(len(x), len(seeds), -1)
            count = len(seeds)
            yield pa.RecordBatch.from_pydict({
                "seed": pa.array(np.tile(np.array(seeds, dtype=np.int32), len(x))),
                "node_id": pa.array(np.repeat(batch.column("node_id").to_numpy(), count)),
                "label": pa.array(np.repeat(batch.column("label").to_numpy(), count).astype(np.int32)),
                "pred": pa.array(scores.argmax(axis=2).reshape(-1).astype(np.int32)),
            })

    return models.rows.select("node_id", "label", "vec").mapInArrow(predict, "seed int, node_id long, label int, pred int")
