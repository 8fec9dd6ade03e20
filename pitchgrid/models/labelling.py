"""Preliminary team labels: clusters, a farthest triplet of seeds, growth to a fixed point, a classifier, and a last filter.

Rows have a stable id and a histogram. Each round scores all rows against mixtures frozen at its start, then refits; lineage
is cut by a reliable checkpoint per round, and the loop ends when no more rows are taken in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.functions.vectors import bhattacharyya
from pitchgrid.models.clustering import Mixture, distance_kmeans, fit_mixture, gaussian_of, log_likelihood
from pitchgrid.models.kernel_machine import confident, fit_machine
from pitchgrid.operators.aggregation import class_medians
from pitchgrid.operators.ranking import farthest_triplet, pair_distances, rarest_class_first
from pitchgrid.sources.shared import checkpointed

# Distance to the own seed, and the margin to the others, of each growth stage
THRESHOLDS = [(0.15, 0.25), (0.2, 0.3), (0.15, 0.25), (0.2, 0.3)]
MIN_RELATIVE = 0.85


def _relative(rows: DataFrame, score: str) -> DataFrame:
    """rows with rel: score relative to the table's best, at most 1; for a best that isn't positive the ratio is inverted."""
    best = rows.agg(F.max(score)).first()[0]
    return rows.withColumn("rel", F.lit(None).cast("double") if best is None else (F.col(score) / best if best > 0 else F.lit(best) / F.col(score)))


def _seed(members: DataFrame, min_likelihood: float) -> DataFrame:
    """The members most typical of their cluster under one Gaussian."""
    scored = members.withColumn("s", log_likelihood(fit_mixture(members, "hist", 1), F.col("hist")))
    return _relative(scored, "s").where(F.col("rel") >= min_likelihood).select("id", "hist")


def mixture_distance(mixture: Mixture, criterion: str):
    """Distance of the histogram to the mixture's components: their median, or the least."""
    means = [F.array(*[F.lit(max(float(x), 0.0)) for x in m]) for m in mixture.means]
    each = F.array_sort(F.array(*[F.coalesce(bhattacharyya(F.col("hist"), m), F.lit(1.0)) for m in means]))
    n = len(means)
    return (F.get(each, F.lit((n - 1) // 2)) + F.get(each, F.lit(n // 2))) / 2 if criterion == "median" else F.get(each, F.lit(0))


def grow(pool: DataFrame, seeds: list[DataFrame], components: int = 1, criterion: str = "median", thresholds=THRESHOLDS) -> DataFrame:
    """(id, hist, node): the seeds of three nodes and what they take in from pool(id, hist), to a fixed point."""
    taken = seeds[0].withColumn("node", F.lit(0))
    for k, s in enumerate(seeds[1:], 1):
        taken = taken.unionByName(s.withColumn("node", F.lit(k)))
    taken = checkpointed(taken)
    count = taken.count()
    for near, margin in thresholds:
        while True:  # rows are only taken in, so their number ends the loop
            mixtures = [fit_mixture(taken.where(F.col("node") == k), "hist", components) for k in range(len(seeds))]
            rest = pool.join(taken.select("id"), "id", "left_anti")
            for k, m in enumerate(mixtures):
                best = taken.where(F.col("node") == k).agg(F.max(log_likelihood(m, F.col("hist")))).first()[0]
                own = log_likelihood(m, F.col("hist"))
                rest = rest.withColumn(f"rel{k}", own / best if best > 0 else F.lit(best) / own).withColumn(f"d{k}", mixture_distance(m, criterion))
            distances = F.array(*[F.col(f"d{k}") for k in range(len(seeds))])
            ordered = F.array_sort(distances)
            ok = (F.greatest(*[F.col(f"rel{k}") for k in range(len(seeds))]) >= MIN_RELATIVE) & (ordered[0] < near) & (ordered[0] < ordered[1] - margin)
            new = rest.where(ok).select("id", "hist", (F.array_position(distances, F.array_min(distances)) - 1).cast("int").alias("node"))
            taken = checkpointed(taken.unionByName(new))
            before, count = count, taken.count()
            if count == before:
                break
    return taken


def large_clusters(found: DataFrame, min_cluster: int) -> DataFrame:
    """(cluster, n) of the clusters with more than min_cluster members."""
    return found.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > min_cluster)


def label_players(
    rows: DataFrame, clusters: int = 10, min_cluster: int = 100, min_likelihood: float = 0.99, min_probability: float = 0.99,
    gamma: float = 0.1, components: int = 1, distance: str = "bhattacharyya", min_candidate_likelihood: float = 0.99,
) -> DataFrame:
    """(id, category, probability): 0 for the referee, 1 and 2 for the teams.

    min_probability is the gate of a kernel machine whose probabilities are calibrated on rows that it hasn't seen; a class
    of n grown rows can't pass (n + 1) / (n + 2). Of the candidates that pass it, those stay whose likelihood under one Gaussian of their class is over
    min_candidate_likelihood of the best; 0 or less keeps all with a likelihood.
    """
    found = checkpointed(distance_kmeans(checkpointed(rows.select("id", "hist")), "hist", "id", clusters, distance)[0])
    large = [r[0] for r in large_clusters(found, min_cluster).orderBy("cluster").collect()]  # at most clusters rows
    if len(large) < 3:
        raise ValueError(f"only {len(large)} clusters have more than {min_cluster} members; three are needed")
    medians = class_medians(found.where(F.col("cluster").isin(large)).withColumnRenamed("cluster", "category"))
    corner = farthest_triplet(pair_distances(medians.select(F.col("category").alias("k"), F.col("median").alias("hist")))).first()
    if corner is None:
        raise ValueError("no three clusters span a triangle")
    seeds = [_seed(found.where(F.col("cluster") == corner[c]), min_likelihood) for c in "abc"]
    grown = grow(found.select("id", "hist"), seeds, components)
    machine = fit_machine(grown, "hist", "node", "id", gamma)
    guessed = confident(rows.select("id", "hist"), machine, "hist", 0.0).withColumnRenamed("category", "old")
    guessed = checkpointed(guessed.select("id", "hist", "old", "probability"))
    renamed = guessed.join(F.broadcast(rarest_class_first(guessed)), "old")  # three classes
    candidates = renamed.where(F.col("probability") >= min_probability).select("id", "hist", "category", "probability")
    return relative_likelihood_filter(candidates, min_candidate_likelihood)


def class_gaussians(members: DataFrame) -> dict:
    """{category: one Gaussian} of members(category, hist), by moments: a few numbers per class reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            groups: dict = {}
            for c, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                groups.setdefault(c, []).append(h)
            for c, rows in groups.items():
                x = np.hstack([np.ones((len(rows), 1)), np.asarray(rows, float)])
                held[c] = held[c] + x.T @ x if c in held else x.T @ x
        for c, m in held.items():
            yield pa.RecordBatch.from_pydict({"category": pa.array([c] * m.size, pa.int64()), "pos": np.arange(m.size), "v": m.ravel()})

    known = members.where(F.col("hist").isNotNull()).select(F.col("category").cast("bigint"), F.col("hist").cast("array<double>"))
    parts = known.mapInArrow(sums, "category bigint, pos bigint, v double").groupBy("category", "pos").agg(F.sum("v").alias("v"))
    found: dict = {}
    for r in parts.orderBy("category", "pos").collect():
        found.setdefault(r["category"], []).append(r["v"])
    return {c: gaussian_of(np.asarray(v)) for c, v in found.items()}


def relative_likelihood_filter(members: DataFrame, min_likelihood: float = 0.99) -> DataFrame:
    """Members of each class whose likelihood under one Gaussian of the class is near the best; classes are a handful.

    One pass takes the moments of all classes, a second one the scores, which are written.
    """
    gaussians = class_gaussians(members)

    @F.arrow_udf(T.DoubleType())
    def score(category: pa.Array, hist: pa.Array) -> pa.Array:
        out: list[float | None] = [None] * len(category)
        groups: dict = {}
        for i, (c, h) in enumerate(zip(category.to_pylist(), hist.to_pylist(), strict=True)):
            if h is not None:
                groups.setdefault(c, []).append((i, h))
        for c, rows in groups.items():
            for (i, _), s in zip(rows, gaussians[c].log_likelihood(np.asarray([h for _, h in rows], float)).tolist(), strict=True):
                out[i] = s
        return pa.array(out, pa.float64())

    scored = checkpointed(members.withColumn("__s", score(F.col("category").cast("bigint"), F.col("hist").cast("array<double>"))))
    best = F.broadcast(scored.groupBy(F.col("category").alias("__c")).agg(F.max("__s").alias("__best")))  # one row a class
    ratio = F.when(F.col("__best") > 0, F.col("__s") / F.col("__best")).otherwise(F.try_divide(F.col("__best"), F.col("__s")))
    return scored.join(best, F.col("category").eqNullSafe(F.col("__c"))).where(ratio > min_likelihood).drop("__s", "__c", "__best")


def label_dark_and_bright(rows: DataFrame, **options) -> DataFrame:
    """label_players apart for rows(id, hist, is_dark), the bright side's teams renamed to the dark side's nearest."""
    return with_names_of(*(label_players(rows.where(c), **options) for c in (F.col("is_dark"), ~F.col("is_dark"))))


def with_names_of(dark: DataFrame, bright: DataFrame) -> DataFrame:
    """dark and bright as one table; bright's teams 1 and 2 trade names if dark's are nearer that way."""
    from pitchgrid.operators.ranking import closest_pairs

    pair = closest_pairs(class_medians(dark), class_medians(bright), [1, 2]).first()
    swap = pair is not None and pair["dark"] != pair["bright"]
    renamed = F.when(F.col("category").isin(1, 2), 3 - F.col("category")).otherwise(F.col("category"))
    return dark.unionByName(bright.withColumn("category", renamed) if swap else bright)


