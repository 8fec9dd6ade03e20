"""Invariants of the learned models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchgrid.models import classifier, clustering, labelling


@pytest.fixture(scope="module")
def teams(spark):
    rng = np.random.default_rng(0)
    centres, rows = np.array([[8, 1, 1, 1], [1, 8, 1, 1], [1, 1, 8, 1]]) / 11, []
    for k, n in enumerate((20, 60, 60)):
        for _ in range(n):
            h = np.clip(centres[k] + rng.normal(0, 0.01, 4), 0.001, None)
            rows.append((len(rows), k, (h / h.sum()).tolist()))
    return spark.createDataFrame(rows, "id int, truth int, hist array<double>").cache()


def test_gaussian_against_numpy(spark, teams):
    x = np.array([r.hist for r in teams.collect()])
    g = clustering.fit_mixture(teams, "hist", 1)
    assert np.allclose(g.means[0], x.mean(axis=0)) and np.allclose(g.covariances[0], np.cov(x.T, bias=True))
    c = g.covariances[0] + clustering.RIDGE * np.eye(4)
    d = x[0] - g.means[0]
    want = -0.5 * (d @ np.linalg.solve(c, d) + np.log(np.linalg.det(c)) + 4 * np.log(2 * np.pi))
    assert abs(g.log_likelihood(x[:1])[0] - want) < 1e-6
    got = teams.select(clustering.log_likelihood(g, F.col("hist"))).first()[0]
    assert abs(got - want) < 1e-6


def test_kmeans_separates(teams):
    pairs = clustering.kmeans(teams, "hist", 3, root=True).select("truth", "cluster").distinct().collect()
    assert len(pairs) == 3


def test_labels_follow_the_teams(teams):
    out = labelling.label_players(teams.select("id", "hist"), clusters=3, min_cluster=10, min_likelihood=0.3, min_probability=0.5, min_candidate_likelihood=0.2).join(teams, "id").collect()
    assert len(out) > 100
    assert {(r.truth == 0) for r in out if r.category == 0} == {True}
    assert len({(r.truth, r.category) for r in out}) == 3


def test_too_few_clusters_is_an_error(teams):
    with pytest.raises(ValueError, match="three are needed"):
        labelling.label_players(teams.select("id", "hist"), clusters=3, min_cluster=50)


def test_classifier_scores(teams):
    model = classifier.fit(teams, "hist", "truth")
    rows = classifier.classify(model, teams, "hist").collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and int(np.argmax(r.logits)) == r.truth for r in rows)


def test_relative_likelihood_filter(spark, teams):
    members = teams.withColumnRenamed("truth", "category")
    kept = labelling.relative_likelihood_filter(members, 0.5)
    assert 0 < kept.count() <= teams.count()
    want = set()
    for c in range(3):
        own = [r for r in members.collect() if r.category == c]
        x = np.array([r.hist for r in own])
        s = clustering.Mixture(np.ones(1), x.mean(axis=0)[None], np.cov(x.T, bias=True)[None]).log_likelihood(x)
        want |= {r.id for r, v in zip(own, s, strict=True) if (v / s.max() if s.max() > 0 else s.max() / v) > 0.5}
    assert {r.id for r in kept.collect()} == want
    assert labelling.relative_likelihood_filter(members.limit(0)).count() == 0


def test_labels_drop_planted_outliers(spark, teams):
    """A histogram between team and nothing passes the classifier's gate, but not the last filter."""
    odd = spark.createDataFrame([(1000, [0.2, 0.74, 0.03, 0.03]), (1001, [0.02, 0.5, 0.02, 0.46])], "id int, hist array<double>")
    rows = teams.select("id", "hist").unionByName(odd)
    loose, strict = ({r.id for r in labelling.label_players(rows, clusters=3, min_cluster=10, min_likelihood=0.3, min_probability=0.5, min_candidate_likelihood=x).collect()} for x in (-1e9, 0.2))
    assert 1000 in loose and not strict & {1000, 1001} and len(strict) > 100


@pytest.mark.parametrize("distance", ["bhattacharyya", "euclidean"])
def test_kmeans_under_a_distance_equals_numpy(spark, distance):
    rng = np.random.default_rng(5)
    x = rng.dirichlet([0.6] * 6, 120)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "id int, hist array<double>").cache()
    found, centres = clustering.distance_kmeans(rows, "hist", "id", 5, distance)
    c = clustering.first_centres(rows, "hist", "id", 5)

    def label(c):
        if distance == "euclidean":
            return np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2)).argmin(axis=1)
        shared = np.sqrt(x[:, None] * c[None]).sum(axis=2) / np.sqrt(x.sum(axis=1)[:, None] * c.sum(axis=1))
        return np.sqrt(np.maximum(1 - shared, 0)).argmin(axis=1)

    for _ in range(100):
        at = label(c)
        new = np.array([x[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(5)])
        done, c = np.sqrt(((new - c) ** 2).sum(axis=1)).sum() <= 1e-6, new
        if done:
            break
    assert np.allclose(centres, c)
    assert {r.id: r.cluster for r in found.collect() if r.hist} == dict(enumerate(label(c).tolist()))


def test_kmeans_of_few_rows_and_a_centre_without_rows(spark):
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(4)], "id int, hist array<double>")
    found, centres = clustering.distance_kmeans(same, "hist", "id", 3)
    assert {r.cluster for r in found.collect()} == {0} and np.allclose(centres, 0.5)
    empty, none = clustering.distance_kmeans(same.limit(0), "hist", "id", 3)
    assert empty.count() == 0 and len(none) == 0


def test_best_model_by_validation_loss(teams, tmp_path):
    valid = teams.where("id % 5 = 0")
    model, metrics = classifier.fit_best(teams.where("id % 5 <> 0"), valid, "hist", "truth", (1e-4, 10.0), path=str(tmp_path / "best"))
    rows = metrics.collect()
    assert rows[0].loss < rows[1].loss and rows[0].accuracy == 1 and (tmp_path / "best" / "metadata").exists()


def test_scores_and_moments_take_columns_whole(spark, monkeypatch):
    """Nulls keep their places, and no row becomes a Python list."""
    import pyarrow as pa

    from pitchgrid.models import clustering

    rows = [[1.0, 2.0], None, [3.0, 5.0], [2.0, 2.5], [0.0, None]]
    assert np.array_equal(clustering.matrix(pa.array(rows)), np.array([[1, 2], [3, 5], [2, 2.5], [0, np.nan]]), equal_nan=True)
    assert np.array_equal(clustering.matrix(pa.array([[9.0, 9.0], *rows[:4]]).slice(1)), np.array([[1, 2], [3, 5], [2, 2.5]]))
    assert clustering.matrix(pa.array([None], pa.list_(pa.float64()))).shape == (0, 0)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows[:4])], "i int, x array<double>").coalesce(1)
    one = clustering.fit_mixture(df, "x", 1)
    x = np.array([r for r in rows[:4] if r])
    assert np.allclose(one.means[0], x.mean(axis=0)) and np.allclose(one.covariances[0], np.cov(x.T, bias=True))
    got = {r.i: r.s for r in df.select("i", clustering.log_likelihood(one, F.col("x")).alias("s")).collect()}
    assert got.pop(1) is None and np.allclose([got[k] for k in (0, 2, 3)], one.log_likelihood(x))
