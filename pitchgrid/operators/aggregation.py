"""Aggregations: counts, histograms, medians, second moments, confusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchgrid.functions.vectors import orientation
from pitchgrid.operators.placing import largest_group
from pitchgrid.sources.shared import checkpointed

#: Rows of a group whose median one task takes; buckets of a round of the selection beyond that.
HEAP_ROWS, BUCKETS = 1_000_000, 1024


def count_instances(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(category, n) for every class of the dimension, zero included."""
    counts = members.groupBy("category").agg(F.count("*").alias("n"))
    return classes.select("category").join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def histogram(rows: DataFrame, by: list[str], value: str, bins: int, low: float, high: float) -> DataFrame:
    """(by, bin, share) of values from low to high, the last bin closed; shares sum to 1 per group. Empty bins are left out."""
    width = (high - low) / bins
    inside = rows.where((F.col(value) >= low) & (F.col(value) <= high))
    place = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by))).drop("n")


def dense_histograms(sparse: DataFrame, by: list[str], bins: int) -> DataFrame:
    """(by, hist): an array of bins shares from the rows of histogram."""
    pairs = F.map_from_entries(F.collect_list(F.struct("bin", "share")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    return sparse.groupBy(*by).agg(pairs.alias("m")).select(*by, filled.alias("hist"))


def _narrowed(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """targets(by, side, rank, lo, hi) narrowed to the bucket that holds the rank; rank counts from the first value in lo..hi."""
    inside = rows.join(targets, by).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    share = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    counts = inside.groupBy(*by, "side", "rank", bucket.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # a window has BUCKETS rows at most
    before = F.coalesce(F.sum("n").over(W.partitionBy(*by, "side").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = counts.withColumn("before", before).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    return found.select(*by, "side", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi")


def exact_medians(rows: DataFrame, by: list[str], value: str, heap_rows: int = HEAP_ROWS) -> DataFrame:
    """(by, m): the median of value per group, interpolated; nulls are left out.

    Groups of up to heap_rows rows are sorted in a task each. Beyond that the two middle ranks are selected: values are
    counted in BUCKETS buckets between the least and the largest, and only the bucket that holds the rank is looked at
    again, until it has one distinct value. Counts combine in the map tasks, so no group is gathered.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    if largest_group(rows, by) <= heap_rows:
        return rows.groupBy(*by).agg(F.median("v").alias("m"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.expr(f"(n - {1 - k}) div 2").alias("rank")) for k in (0, 1)])).alias("s")
    targets = checkpointed(ends.select(*by, sides, "lo", "hi").select(*by, "s.*", "lo", "hi"))
    done = targets.where("lo = hi")
    while not (targets := targets.where("lo < hi")).isEmpty():
        targets = checkpointed(_narrowed(rows, targets, by))
        done = done.unionByName(targets.where("lo = hi"))
    return done.groupBy(*by).agg(F.avg("lo").alias("m"))


def class_medians(members: DataFrame, heap_rows: int = HEAP_ROWS) -> DataFrame:
    """(category, median): the element-wise median of hist per class, interpolated."""
    each = members.select("category", F.posexplode("hist").alias("pos", "v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return exact_medians(each, ["category", "pos"], "v", heap_rows).groupBy("category").agg(F.transform(ordered, lambda x: x["m"]).alias("median"))


def second_moments(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Sums of u*u, v*v, u*v, the count, and the signs' counts; partial sums combine in the map tasks."""
    up = lambda c: F.count_if((F.col(c) >= 0) & (F.col(c) <= 1))
    down = lambda c: F.count_if((F.col(c) >= -1) & (F.col(c) < 0))
    product = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b).cast("double"))
    return vectors.groupBy(*by).agg(
        product("u", "u").alias("suu"), product("v", "v").alias("svv"), product("u", "v").alias("suv"), F.count("*").alias("n"),
        up("u").alias("u_up"), down("u").alias("u_down"), up("v").alias("v_up"), down("v").alias("v_down"),
    )


def dominant_orientation(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, vx, vy): dominant motion of each group of flow vectors u, v."""
    m = second_moments(vectors, by)
    vx, vy = orientation(*[F.col(c) for c in ("suu", "svv", "suv", "n", "u_up", "u_down", "v_up", "v_down")])
    return m.select(*by, vx.alias("vx"), vy.alias("vy"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(truth, guess, n, share) with shares of each truth's row; pairs has truth and guess."""
    counts = pairs.groupBy("truth", "guess").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("truth")))


def running_mean(rows: DataFrame, by: list[str], order: list[str], value: str, weight: str | None = None) -> DataFrame:
    """rows with running_mean: the weighted mean so far. Give value in integers for results that don't depend on order."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    k = F.col(weight) if weight else F.lit(1)
    return rows.withColumn("running_mean", F.try_divide(F.sum(F.col(value) * k).over(w).cast("double"), F.sum(k).over(w).cast("double")))


def mean_vectors(frames: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean): the element-wise mean of the arrays values of each group; partial sums combine in the map tasks."""
    each = frames.select(*by, F.posexplode("values").alias("pos", "v"))
    means = each.groupBy(*by, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(*by).agg(F.transform(ordered, lambda x: x["m"]).alias("mean"))


def temporal_mean(frames: DataFrame, by: list[str], cap: float | None = None) -> DataFrame:
    """(by, pos, mean): mean of absolute values at each place of the frames' arrays, capped."""
    each = frames.select(*by, F.posexplode("values").alias("pos", "v"))
    mean = F.avg(F.abs(F.col("v").cast("double")))
    return each.groupBy(*by, "pos").agg((F.least(mean, F.lit(cap)) if cap is not None else mean).alias("mean"))
