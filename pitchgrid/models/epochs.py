"""A class regression trained epoch by epoch: mini-batches, a plateau schedule, and a state that a later run resumes.

Rows are dealt into batches once and written by batch, so a step reads its own rows only. Tasks sum their rows' gradients and
Spark sums the tasks'; what reaches the driver is one number per weight. Each epoch's state is one row of a written table: a
run that was stopped goes on after the last epoch that was committed, with the same numbers as if it hadn't been.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.plans.config import TrainingConfig
from pitchgrid.sources.shared import new_path

# Decay of the two moments and their guard; the plateau's factor, relative threshold and least change
DECAY, SQUARE_DECAY, GUARD = 0.9, 0.999, 1e-8
FACTOR, THRESHOLD, LEAST_CHANGE = 0.1, 1e-4, 1e-8

STATE = (
    "epoch int, train_loss double, valid_loss double, accuracy double, learning_rate double, best_loss double, bad_epochs int, "
    "steps bigint, last boolean, weights array<double>, moments array<double>, squares array<double>"
)


def usable(column: str, label: str, features: int, classes: int) -> Column:
    """Whether a row has a class and as many finite numbers as there are features; others teach nothing and are not counted."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce((F.size(x) == features) & F.col(label).between(0, classes - 1) & finite, F.lit(False))


def summed_gradient(rows: DataFrame, column: str, label: str, weights: np.ndarray) -> DataFrame:
    """(place, total) of sums over usable rows: the cross-entropy's gradient by weight, then rows, loss and right guesses.

    weights is classes x (features + 1), the intercepts last; its places count row by row.
    """
    classes, width = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights.size + 3)
        for batch in batches:
            y = batch["y"].to_numpy(zero_copy_only=False)
            if not len(y):
                continue
            x = np.hstack([batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(y), width - 1), np.ones((len(y), 1))])
            scores = x @ weights.T
            scores -= scores.max(axis=1, keepdims=True)
            logs = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
            own = np.eye(classes)[y]
            total[: weights.size] += ((np.exp(logs) - own).T @ x).ravel()
            total[weights.size :] += len(y), -(logs * own).sum(), (scores.argmax(axis=1) == y).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["place", "v"])

    numbers = rows.where(usable(column, label, width - 1, classes)).select(F.col(column).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    return numbers.mapInArrow(run, "place int, v double").groupBy("place").agg(F.sum("v").alias("total"))


def _totals(rows: DataFrame, column: str, label: str, weights: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    out = np.zeros(weights.size + 3)
    for r in summed_gradient(rows, column, label, weights).collect():
        out[r.place] = r.total
    return out[: weights.size].reshape(weights.shape), *out[weights.size :].tolist()


@dataclass
class Training:
    """What one epoch hands to the next."""

    weights: np.ndarray
    moments: np.ndarray
    squares: np.ndarray
    learning_rate: float
    epoch: int = 0
    best_loss: float = float("inf")
    bad_epochs: int = 0
    steps: int = 0
    last: bool = False

    def step(self, gradient: np.ndarray) -> None:
        """Move the weights against a mean gradient, each by its own scale."""
        self.steps += 1
        self.moments = DECAY * self.moments + (1 - DECAY) * gradient
        self.squares = SQUARE_DECAY * self.squares + (1 - SQUARE_DECAY) * gradient**2
        scale = np.sqrt(self.squares / (1 - SQUARE_DECAY**self.steps)) + GUARD
        self.weights = self.weights - self.learning_rate / (1 - DECAY**self.steps) * self.moments / scale

    def judge(self, loss: float, patience: int) -> None:
        """Lower the rate after more than patience epochs without a better loss; the last epoch is one at a least rate that doesn't help."""
        before = self.learning_rate
        if loss < self.best_loss * (1 - THRESHOLD):
            self.best_loss, self.bad_epochs = loss, 0
        else:
            self.bad_epochs += 1
        if self.bad_epochs > patience:
            self.bad_epochs = 0
            if self.learning_rate * (1 - FACTOR) > LEAST_CHANGE:
                self.learning_rate *= FACTOR
        self.last = before < 2 * LEAST_CHANGE and self.bad_epochs >= patience


def _saved(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(STATE).parquet(path)
    except AnalysisException:
        return None


def _resumed(spark: SparkSession, path: str, start: Training) -> Training:
    saved = _saved(spark, path)
    row = saved.orderBy(F.desc("epoch")).first() if saved is not None else None
    if row is None:
        return start
    arrays = (np.array(row[c]).reshape(start.weights.shape) for c in ("weights", "moments", "squares"))
    return Training(*arrays, row.learning_rate, row.epoch, row.best_loss, row.bad_epochs, row.steps, row.last)


def batched(rows: DataFrame, key: str, config: TrainingConfig) -> tuple[DataFrame, int]:
    """rows written by batch, and the number of batches; a batch is drawn from the key, so any run deals rows alike.

    Batches have batch_size rows on average, more if there would be over max_steps of them.
    """
    n = rows.count()
    if not n:
        raise ValueError("no rows to learn from")
    steps = min(-(-n // config.batch_size), config.max_steps)
    path = new_path(rows.sparkSession, "batches")
    rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(config.seed), key), F.lit(steps)).cast("int")).write.partitionBy("batch").parquet(path)
    return rows.sparkSession.read.parquet(path), steps


def train_epochs(train: DataFrame, valid: DataFrame, column: str, label: str, key: str, features: int, config: TrainingConfig, path: str) -> DataFrame:
    """The states of all epochs, also in path: losses, accuracy on valid, rate, weights. The best one has the least valid_loss.

    Every epoch goes through all batches in an order drawn from the seed and the epoch's number. Without usable validation
    rows the training loss decides and the accuracy is null.
    """
    spark = train.sparkSession
    table, steps = batched(train.where(usable(column, label, features, config.classes)).select(key, column, label), key, config)
    zero = np.zeros((config.classes, features + 1))
    state = _resumed(spark, path, Training(zero, zero, zero, config.learning_rate))
    while state.epoch < config.max_epochs and not state.last:
        state.epoch += 1
        seen = loss = 0.0
        for batch in np.random.default_rng([config.seed, state.epoch]).permutation(steps):
            gradient, n, lost, _ = _totals(table.where(F.col("batch") == int(batch)), column, label, state.weights)
            if n:
                state.step(gradient / n)
                seen, loss = seen + n, loss + lost
        _, n, lost, right = _totals(valid, column, label, state.weights)
        valid_loss = lost / n if n else None
        state.judge(loss / seen if valid_loss is None else valid_loss, config.patience)
        arrays = [a.ravel().tolist() for a in (state.weights, state.moments, state.squares)]
        row = (state.epoch, loss / seen, valid_loss, right / n if n else None, state.learning_rate, state.best_loss, state.bad_epochs, state.steps, state.last, *arrays)
        spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(path)
    return _saved(spark, path)


def best_weights(states: DataFrame, classes: int) -> np.ndarray:
    """classes x (features + 1) weights of the first epoch with the least loss."""
    row = states.orderBy(F.coalesce("valid_loss", "train_loss"), "epoch").select("weights").first()
    return np.array(row.weights).reshape(classes, -1)
