"""The kernel machine: its fit against all rows in numpy, its probabilities against frequencies, and the gate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchgrid.models import kernel_machine as K


def drawn(n, spread, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0.0, 0.0], [2.0, 0.0], [0.0, 2.0]])
    return [(i, int(y), (centres[y] + rng.normal(0, spread, 2)).tolist()) for i, y in enumerate(rng.integers(0, 3, n))]


def table(spark, rows):
    return spark.createDataFrame(rows, "id int, y int, x array<double>").repartition(3)


def test_the_machine_is_where_the_loss_is_least(spark):
    rows = drawn(150, 0.8)
    m = K.fit_machine(table(spark, rows), "x", "y", "id", gamma=0.5, landmarks=30)
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    f = m.features(x)
    for w, (a, b) in zip(m.weights, [(0, 1), (0, 2), (1, 2)], strict=True):
        own = (y == a) | (y == b)
        sign = np.where(y[own] == a, 1, -1)
        miss = np.maximum(1 - sign * (f[own] @ w), 0)
        gradient = np.append(w[:-1], 0) - 2 * (f[own] * (sign * miss)[:, None]).sum(axis=0)
        assert np.abs(gradient).max() < 1e-3
    # with all rows as landmarks the features' dot products are the kernel's
    whole = K.fit_machine(table(spark, rows[:40]), "x", "y", "id", gamma=0.5, landmarks=1000)
    g = whole.features(x[:40])[:, :-1]
    assert np.allclose(g @ g.T, np.exp(-0.5 * ((x[:40, None] - x[None, :40]) ** 2).sum(axis=2)), atol=1e-3)


def test_probabilities_are_frequencies(spark):
    m = K.fit_machine(table(spark, drawn(1500, 0.9)), "x", "y", "id", gamma=0.3)
    fresh = table(spark, drawn(4000, 0.9, seed=1))
    scored = K.confident(fresh, m, "x", 0.0).withColumn("right", F.col("category") == F.col("y"))
    rows = [r for r in K.reliability(scored, "probability", "right").collect() if r.n >= 100]
    gaps = {r.bin: (r.n, r.mean_probability - r.share_correct) for r in rows}
    assert len(rows) >= 4 and all(abs(g) < 0.1 for _, g in gaps.values()), gaps
    assert sum(n * abs(g) for n, g in gaps.values()) / sum(n for n, _ in gaps.values()) < 0.04, gaps


def test_the_gate_at_0_99_is_right_99_times_in_100(spark):
    m = K.fit_machine(table(spark, drawn(1500, 0.5)), "x", "y", "id", gamma=0.3)
    sure = K.confident(table(spark, drawn(4000, 0.5, seed=1)), m, "x", 0.99)
    n, right = sure.agg(F.count("*"), F.avg((F.col("category") == F.col("y")).cast("double"))).first()
    assert n > 500 and right >= 0.99, (n, right)


def test_coupling_gives_back_consistent_pairs():
    p = np.random.default_rng(1).dirichlet([1.0] * 4, 50)
    pairs = np.stack([p[:, a] / (p[:, a] + p[:, b]) for a in range(4) for b in range(a + 1, 4)], axis=1)
    assert np.allclose(K.coupled(pairs, 4), p, atol=1e-5)


def test_nulls_labels_of_any_number_and_too_few_classes(spark):
    rows = [(i, 10 * y + 3, x) for i, y, x in drawn(90, 0.3)] + [(500, None, [0.0, 0.0]), (501, 3, None)]
    m = K.fit_machine(table(spark, rows), "x", "y", "id", gamma=0.5, landmarks=12)
    assert m.classes == [3, 13, 23]
    out = K.confident(table(spark, rows), m, "x", 0.5).collect()
    assert 501 not in {r.id for r in out} and all(r.category == r.y for r in out if r.y is not None) and len(out) > 80
    with pytest.raises(ValueError, match="two are needed"):
        K.fit_machine(table(spark, [(1, 1, [0.0])]), "x", "y", "id")
