"""A kernel machine with calibrated probabilities, trained by sums over the rows.

Landmarks, a bounded sample of ``LANDMARKS`` rows with equal shares of the classes, span the machine: a row's features are its
radial kernel values with them, turned so that dot products are the kernel's (Nystroem). Each pair of classes has a machine of
its own with a squared hinge loss, fitted by Newton steps: one pass over the rows gives gradients and Hessians of all pairs,
on all rows and without each fold, at the same time. Decisions of the rows that a machine hasn't seen are turned into
probabilities by a logistic curve per pair (Platt), and pairs are coupled into one distribution over the classes.

Everything that reaches the driver is sums of a fixed size. Classes are a handful: machines grow with the square of their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.models.clustering import SEED
from pitchgrid.sources.shared import checkpointed

LANDMARKS, FOLDS, STEPS, CURVE_STEPS, TOLERANCE = 96, 5, 30, 50, 1e-4
#: Eigenvalues of the landmarks' kernel below this share of the largest are left out.
RANK = 1e-6


@dataclass
class KernelMachine:
    """Landmarks, their feature map, and per pair of classes the weights of its machine and its logistic curve."""

    classes: list[int]
    landmarks: np.ndarray
    turn: np.ndarray
    gamma: float
    weights: np.ndarray
    curves: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Features of rows of x, the last one constant."""
        apart = ((x[:, None, :] - self.landmarks[None]) ** 2).sum(axis=2)
        return np.hstack([np.exp(-self.gamma * apart) @ self.turn, np.ones((len(x), 1))])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One row of class probabilities for each row of x."""
        f = self.features(x) @ self.weights.T
        return coupled(1 / (1 + np.exp(np.clip(self.curves[:, 0] * f + self.curves[:, 1], -700, 700))), len(self.classes))


def coupled(pairs: np.ndarray, k: int) -> np.ndarray:
    """Class probabilities p from those of each pair's first class: the least sum of (r_ba p_a - r_ab p_b) squared with sum 1."""
    r = np.full((len(pairs), k, k), 0.0)
    for column, (a, b) in enumerate(combinations(range(k), 2)):
        r[:, a, b] = np.clip(pairs[:, column], 1e-7, 1 - 1e-7)
        r[:, b, a] = 1 - r[:, a, b]
    q = -r * r.transpose(0, 2, 1)
    q[:, range(k), range(k)] = (r.transpose(0, 2, 1) ** 2).sum(axis=2)
    system = np.zeros((len(pairs), k + 1, k + 1))
    system[:, :k, :k], system[:, :k, k], system[:, k, :k] = q, 1, 1
    p = np.clip(np.linalg.solve(system, np.tile(np.eye(k + 1)[k], (len(pairs), 1))[..., None])[:, :k, 0], 0, None)
    return p / p.sum(axis=1, keepdims=True)


def _sums(rows: DataFrame, size: int, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over rows(x, y, fold) of arrays of a fixed size that f gives for blocks of rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += f(np.asarray(batch["x"].to_pylist(), float), np.asarray(batch["y"]), np.asarray(batch["fold"])).ravel()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pos": some, "v": total[some]}, pa.schema([("pos", pa.int64()), ("v", pa.float64())]))

    out = np.zeros(size)
    for r in rows.mapInArrow(add, "pos bigint, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect():
        out[r["pos"]] = r["v"]
    return out


def _landmarks(rows: DataFrame, classes: list[int], n: int) -> np.ndarray:
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.col("id").cast("string")))
    share = -(-n // len(classes))
    each = [rows.where(F.col("y") == c).orderBy(order, "x").limit(share).select("x") for c in classes]
    return np.unique(np.asarray([r[0] for r in reduce(DataFrame.unionAll, each).collect()], float), axis=0)


def fit_machine(rows: DataFrame, column: str, label: str, key: str, gamma: float = 0.1, cost: float = 1.0, landmarks: int = LANDMARKS, folds: int = FOLDS) -> KernelMachine:
    """A machine of integer labels from an array column; rows with nulls are left out. key gives landmarks and folds."""
    known = rows.where(F.col(column).isNotNull() & F.col(label).isNotNull())
    fold = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(folds)).cast("int")
    known = checkpointed(known.select(F.col(key).cast("string").alias("id"), F.col(column).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), fold.alias("fold")))
    classes = [r[0] for r in known.select("y").distinct().orderBy("y").collect()]
    if len(classes) < 2:
        raise ValueError(f"only {len(classes)} classes; two are needed")
    points = _landmarks(known, classes, landmarks)
    values, vectors = np.linalg.eigh(np.exp(-gamma * ((points[:, None] - points[None]) ** 2).sum(axis=2)))
    keep = values > RANK * values.max()
    machine = KernelMachine(classes, points, vectors[:, keep] / np.sqrt(values[keep]), gamma, np.zeros((0, 0)), np.zeros((0, 2)))
    pairs, d = list(combinations(classes, 2)), int(keep.sum()) + 1
    held = [*range(folds), -1]  # the fold that a machine doesn't see; the last sees all
    models = [(a, b, h) for a, b in pairs for h in held]
    w, ridge = np.zeros((len(models), d)), np.diag([1.0] * (d - 1) + [1e-8])

    def newton(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Gradient and Hessian of the loss of each model, from the rows inside its margin."""
        f = machine.features(x)
        out = np.zeros((len(models), d, d + 1))
        for m, (a, b, h) in enumerate(models):
            sign = np.where(y == a, 1.0, -1.0)
            inside = ((y == a) | (y == b)) & (fold != h) & (sign * (f @ w[m]) < 1)
            g = f[inside]
            out[m, :, 0], out[m, :, 1:] = g.T @ (g @ w[m] - sign[inside]), g.T @ g
        return out

    for _ in range(STEPS):
        total = 2 * cost * _sums(known, w.size * (d + 1), newton).reshape(len(models), d, d + 1)
        step = np.linalg.solve(ridge + total[:, :, 1:], (w @ ridge + total[:, :, 0])[..., None])[..., 0]
        w = w - step
        if np.abs(step).max() <= TOLERANCE * max(1.0, np.abs(w).max()):
            break
    curves = _curves(known, machine, pairs, held, w.reshape(len(pairs), len(held), d))
    return KernelMachine(classes, points, machine.turn, gamma, w.reshape(len(pairs), len(held), d)[:, -1], curves)


def _curves(known: DataFrame, machine: KernelMachine, pairs: list[tuple[int, int]], held: list[int], w: np.ndarray) -> np.ndarray:
    """(slope, offset) of each pair's logistic curve, on decisions about rows that the machine hasn't seen; targets keep off 0 and 1 by the classes' sizes."""
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    curve = np.array([[0.0, np.log((sizes[b] + 1) / (sizes[a] + 1))] for a, b in pairs])

    def slopes(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        f, out = machine.features(x), np.zeros((len(pairs), 6))
        for m, (a, b) in enumerate(pairs):
            own = (y == a) | (y == b)
            decision = (f[own] * w[m][fold[own]]).sum(axis=1)
            target = np.where(y[own] == a, (sizes[a] + 1) / (sizes[a] + 2), 1 / (sizes[b] + 2))
            z = np.clip(curve[m, 0] * decision + curve[m, 1], -700, 700)
            p = 1 / (1 + np.exp(z))
            loss = np.where(z >= 0, target * z, (target - 1) * z) + np.log1p(np.exp(-np.abs(z)))
            q, miss = p * (1 - p), target - p
            out[m] = (decision**2 * q).sum(), (decision * q).sum(), q.sum(), (decision * miss).sum(), miss.sum(), loss.sum()
        return out

    best, step = np.full(len(pairs), np.inf), np.zeros_like(curve)
    for _ in range(CURVE_STEPS):
        s = _sums(known, 6 * len(pairs), slopes).reshape(len(pairs), 6)
        worse = s[:, 5] > best + 1e-9
        if worse.any():  # half of the last step where it went too far
            step[worse] /= 2
            curve[worse] += step[worse]
            step[~worse] = 0
            if np.abs(step).max() <= TOLERANCE:
                break
            continue
        best = s[:, 5]
        hessian = np.array([[[a + 1e-12, b], [b, c + 1e-12]] for a, b, c in s[:, :3]])
        step = np.linalg.solve(hessian, s[:, 3:5][..., None])[..., 0]
        curve = curve - step
        if np.abs(step).max() <= TOLERANCE * max(1.0, np.abs(curve).max()):
            break
    return curve


def class_probabilities(machine: KernelMachine, column: Column) -> Column:
    """An array of the probabilities of machine.classes; null for a null array."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(values: pa.Array) -> pa.Array:
        rows = values.to_pylist()
        known = [i for i, r in enumerate(rows) if r is not None]
        out: list = [None] * len(rows)
        if known:
            for i, p in zip(known, machine.probabilities(np.asarray([rows[i] for i in known], float)).tolist(), strict=True):
                out[i] = p
        return pa.array(out, pa.list_(pa.float64()))

    return score(column.cast("array<double>"))


def confident(rows: DataFrame, machine: KernelMachine, column: str, min_probability: float = 0.99) -> DataFrame:
    """rows with category and probability, of those whose likeliest class is at least so probable."""
    classes = F.array(*[F.lit(c) for c in machine.classes])
    scored = rows.withColumn("__p", class_probabilities(machine, F.col(column)))
    at = F.array_position("__p", F.array_max("__p")).cast("int") - 1
    named = scored.withColumns({"category": F.get(classes, at), "probability": F.array_max("__p")}).drop("__p")
    return named.where(F.col("probability") >= min_probability)


def reliability(scored: DataFrame, probability: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_probability, share_correct) of predictions by their probability."""
    place = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_probability"), F.avg(F.col(correct).cast("double")).alias("share_correct"))
