"""k-means and Gaussian mixtures over array columns, by pyspark.ml, with log-likelihoods."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.functions.vectors import bhattacharyya, total
from pitchgrid.operators.selection import min_max

SEED, RIDGE = 42, 1e-6


def _vectors(rows: DataFrame, column: str, transform=lambda c: c) -> DataFrame:
    return rows.withColumn("__v", array_to_vector(transform(F.col(column)).cast("array<double>")))


def kmeans(rows: DataFrame, column: str, k: int, root: bool = False, max_iter: int = 20) -> DataFrame:
    """rows with cluster. root: cluster the square roots, whose distance follows the Bhattacharyya distance of histograms."""
    take_root = (lambda c: F.transform(c, lambda x: F.sqrt(x))) if root else (lambda c: c)
    v = _vectors(rows, column, take_root)
    model = KMeans(featuresCol="__v", predictionCol="cluster", k=k, seed=SEED, maxIter=max_iter).fit(v)
    return model.transform(v).drop("__v")


def euclidean(u: Column, v: Column) -> Column:
    return F.sqrt(total(F.zip_with(u, v, lambda x, y: (x - y) * (x - y))))


#: Distances that distance_kmeans knows by name.
DISTANCES = {"euclidean": euclidean, "bhattacharyya": bhattacharyya}


def nearest(column: Column, centres: np.ndarray, distance: Callable[[Column, Column], Column]) -> Column:
    """The number of the nearest of a bounded number of frozen centres, the first among ties; no distance counts as the farthest."""
    each = F.array(*[F.coalesce(distance(column, F.array(*[F.lit(float(x)) for x in c])), F.lit(float("inf"))) for c in centres])
    return (F.array_position(each, F.array_min(each)) - 1).cast("int")


def lloyd_round(rows: DataFrame, column: str, centres: np.ndarray, distance: Callable[[Column, Column], Column]) -> np.ndarray:
    """The means of the rows nearest to each centre; a centre without rows stays. Sums combine in the map tasks, means reach the driver."""
    each = rows.select(nearest(F.col(column), centres, distance).alias("c"), F.posexplode(column).alias("pos", "v"))
    out = centres.copy()
    for r in each.groupBy("c", "pos").agg(F.avg(F.col("v").cast("double")).alias("m")).collect():
        out[r["c"], r["pos"]] = r["m"]
    return out


def first_centres(rows: DataFrame, column: str, key: str, k: int) -> np.ndarray:
    """The arrays of the k rows whose keys have the smallest digests: a start that doesn't depend on the cluster."""
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.col(key).cast("string")))
    return np.asarray([r[0] for r in rows.where(F.col(column).isNotNull()).orderBy(order, key).select(F.col(column).cast("array<double>")).limit(k).collect()], float)


def distance_kmeans(
    rows: DataFrame, column: str, key: str, k: int, distance: str | Callable[[Column, Column], Column] = "bhattacharyya", max_rounds: int = 100, tolerance: float = 1e-6
) -> tuple[DataFrame, np.ndarray]:
    """(rows with cluster, centres) of k-means under any distance of two array columns.

    Rounds assign rows to the nearest of frozen centres and take means, until centres move by no more than tolerance in all.
    Each round is one grouped sum over rows; give a written table. Only k means per round reach the driver.
    """
    metric = DISTANCES[distance] if isinstance(distance, str) else distance
    centres = first_centres(rows, column, key, k)
    for _ in range(max_rounds if len(centres) else 0):
        moved = lloyd_round(rows, column, centres, metric)
        done = np.sqrt(((moved - centres) ** 2).sum(axis=1)).sum() <= tolerance
        centres = moved
        if done:
            break
    return rows.withColumn("cluster", nearest(F.col(column), centres, metric) if len(centres) else F.lit(None).cast("int")), centres


@dataclass
class Mixture:
    """Weights, means and covariances of a fitted mixture."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        """log density of each row of x, the covariances ridged."""
        d, parts = x.shape[1], []
        for w, m, c in zip(self.weights, self.means, self.covariances, strict=True):
            root = np.linalg.cholesky(c + RIDGE * np.eye(d))
            z = np.linalg.solve(root, (x - m).T)
            parts.append(np.log(max(w, 1e-300)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * d * np.log(2 * np.pi))
        top = np.max(parts, axis=0)
        return top + np.log(np.exp(np.asarray(parts) - top).sum(axis=0))


def matrix(arrays: pa.Array) -> np.ndarray:
    """The non-null arrays of a column, all of one length, as the rows of a matrix; null numbers are NaN."""
    known = arrays.drop_null()
    return known.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(known), -1) if len(known) else np.zeros((0, 0))


def fit_gaussian(rows: DataFrame, column: str) -> Mixture:
    """One Gaussian from moments: each task sends its count, sums and products, which are added by position."""

    def moments(batches):
        total = None
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"pos": np.arange(total.size), "v": total.ravel()})

    parts = rows.select(F.col(column).cast("array<double>")).mapInArrow(moments, "pos bigint, v double")
    v = np.asarray([r[1] for r in sorted(parts.groupBy("pos").agg(F.sum("v")).collect())])  # (dimension + 1) squared numbers
    if not len(v):
        raise ValueError("no rows to fit")
    return gaussian_of(v)


def gaussian_of(v: np.ndarray) -> Mixture:
    """The Gaussian of a flat matrix of moments: count, sums and products of (1, x)."""
    d = round(len(v) ** 0.5)
    v = v.reshape(d, d) / v[0]
    return Mixture(np.ones(1), v[:1, 1:], (v[1:, 1:] - np.outer(v[0, 1:], v[0, 1:]))[None])


def fit_mixture(rows: DataFrame, column: str, k: int, max_iter: int = 50) -> Mixture:
    """A mixture of k Gaussians."""
    if k == 1:
        return fit_gaussian(rows, column)
    model = GaussianMixture(featuresCol="__v", k=k, seed=SEED, maxIter=max_iter).fit(_vectors(rows, column))
    found = model.gaussians
    return Mixture(np.asarray(model.weights), np.asarray([g.mean.toArray() for g in found]), np.asarray([g.cov.toArray() for g in found]))


def log_likelihood(mixture: Mixture, column: Column) -> Column:
    """Log-likelihood of an array column under the mixture; null for null arrays."""

    @F.arrow_udf(T.DoubleType())
    def score(values: pa.Array) -> pa.Array:
        known, out = values.is_valid().to_numpy(zero_copy_only=False), np.zeros(len(values))
        if known.any():
            out[known] = mixture.log_likelihood(matrix(values))
        return pa.array(out, pa.float64(), mask=~known)

    return score(column.cast("array<double>"))


def likely_sizes(rows: DataFrame, size: str, k: int = 20, keep: float = 0.5) -> DataFrame:
    """rows whose log-likelihood under a mixture of all sizes, scaled to 0..1 over the table, is over keep."""
    mixture = fit_mixture(rows, size, k)
    scored = rows.withColumn("__score", log_likelihood(mixture, F.col(size)))
    return min_max(scored, "__score").where(F.col("scaled") > keep).drop("__score")
