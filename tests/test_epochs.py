"""Training in epochs against the same rounds in numpy, resuming, and rows that teach nothing."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchgrid.models import epochs
from pitchgrid.plans.config import TrainingConfig

CONFIG = TrainingConfig(classes=3, max_epochs=3, batch_size=20, max_steps=3, learning_rate=0.05, patience=1, seed=7)


def softmax(x, w):
    e = np.exp(x @ w.T)
    return e / e.sum(axis=1, keepdims=True)


def data(spark, n=80):
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, 1, (n, 4)), rng.integers(0, 3, n)
    x[np.arange(n), y] += 2
    return spark.createDataFrame([(i, a, int(b)) for i, (a, b) in enumerate(zip(x.tolist(), y, strict=True))], "id int, v array<double>, c int")


def split(rows):
    return rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")


def run(spark, path, config=CONFIG):
    return epochs.train_epochs(*split(data(spark)), "v", "c", "id", 4, config, path).orderBy("epoch").collect()


def test_trace_equals_numpy(spark, tmp_path):
    got = run(spark, str(tmp_path / "a"))
    rows = data(spark).withColumn("batch", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(3))).collect()
    x = np.array([[*r.v, 1.0] for r in rows])
    own, test, batch = np.eye(3)[[r.c for r in rows]], np.array([r.id % 5 == 0 for r in rows]), np.array([r.batch for r in rows])
    w, m, s, t = np.zeros((3, 5)), 0.0, 0.0, 0
    for epoch in range(1, 4):
        lost = 0.0
        for b in np.random.default_rng([7, epoch]).permutation(3):
            at = ~test & (batch == b)
            p = softmax(x[at], w)
            lost -= np.log((p * own[at]).sum(axis=1)).sum()
            g, t = (p - own[at]).T @ x[at] / at.sum(), t + 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        p = softmax(x[test], w)
        r = got[epoch - 1]
        assert np.allclose([r.train_loss, r.valid_loss], [lost / (~test).sum(), -np.log((p * own[test]).sum(axis=1)).mean()])
        assert np.allclose(r.accuracy, (p.argmax(axis=1) == own[test].argmax(axis=1)).mean()) and np.allclose(r.weights, w.ravel())


def test_a_stopped_run_goes_on(spark, tmp_path):
    whole = run(spark, str(tmp_path / "a"))
    run(spark, str(tmp_path / "b"), dataclasses.replace(CONFIG, max_epochs=1))
    rest = run(spark, str(tmp_path / "b"))
    assert [r.epoch for r in rest] == [1, 2, 3] and all(np.allclose(a.weights, b.weights) for a, b in zip(whole, rest, strict=True))
    states = spark.read.parquet(str(tmp_path / "b"))
    assert np.allclose(epochs.best_weights(states, 3).ravel(), min(rest, key=lambda r: r.valid_loss).weights)


def test_plateau():
    z = np.zeros(1)
    t, rates = epochs.Training(z, z, z, 1e-7), []
    for loss in (1.0, 0.9, 0.9, 0.9, 0.9, 0.9):
        t.judge(loss, 1)
        rates.append((round(t.learning_rate, 12), t.bad_epochs, t.last))
    # two bad epochs beyond a patience of one lower the rate; at the least rate a bad epoch more is the last
    assert rates == [(1e-7, 0, False), (1e-7, 0, False), (1e-7, 1, False), (1e-8, 0, False), (1e-8, 1, True), (1e-8, 0, False)]


def test_rows_that_teach_nothing(spark, tmp_path):
    odd = spark.createDataFrame([(100, None, 1), (101, [1.0], 1), (102, [1.0, 2.0, float("nan"), 0.0], 1), (103, [1.0] * 4, None), (104, [1.0] * 4, 9), (105, [None] * 4, 1)], "id int, v array<double>, c int")
    train, valid = split(data(spark))
    config = dataclasses.replace(CONFIG, max_epochs=1)
    a = epochs.train_epochs(train.union(odd), odd, "v", "c", "id", 4, config, str(tmp_path / "a")).first()
    b = epochs.train_epochs(train, valid, "v", "c", "id", 4, config, str(tmp_path / "b")).first()
    assert np.allclose(a.weights, b.weights) and a.valid_loss is None and a.accuracy is None
    with pytest.raises(ValueError):
        epochs.train_epochs(odd, valid, "v", "c", "id", 4, config, str(tmp_path / "c"))
