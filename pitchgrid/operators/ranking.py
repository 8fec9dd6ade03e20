"""Index grids, splits, numbering, overrides, and combinations of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchgrid.functions.vectors import bhattacharyya, triangle_area
from pitchgrid.operators.placing import placed
from pitchgrid.sources.shared import checkpointed


def flow_index(k: Column, n_flow: Column, n_frames: Column) -> Column:
    """0-based flow frame of video frame k: n_flow spread evenly over n_frames, in exact integers."""
    return F.ceil(n_flow * (k + 1) / n_frames).cast("bigint") - 1


def repaired_flow_index(all_frame: Column, n_flow: Column, n_all: Column) -> Column:
    """Flow frame of an index into all frames."""
    return F.try_divide(all_frame * (n_flow - 1), n_all - 1).cast("int")


def sampling_index(k: Column, n_frames: Column, samples: int) -> Column:
    """Frame of sample k of an even grid over all frames, both ends included."""
    return F.ceil(k * (n_frames - 1) / (samples - 1)).cast("bigint")


def stratified_split(rows: DataFrame, category: str, key: str, share: float, window_rows: int | None = None) -> DataFrame:
    """rows with split: per class round-half-even(share * n) rows are 'valid', one at least if n > 1; by hash order."""
    order = placed(rows.withColumn("__hash", F.md5(F.col(key).cast("string"))), [category], ["__hash", key], window_rows)
    n = F.col("__of")
    wanted = F.when(n > 1, F.greatest(F.bround(F.lit(share) * n, 0), F.lit(1.0))).otherwise(F.lit(0.0))
    return order.withColumn("split", F.when(F.col("__place") < wanted, "valid").otherwise("train")).drop("__hash", "__place", "__of")


def number_within(rows: DataFrame, by: list[str], order: list[str], digits: int = 5, window_rows: int | None = None) -> DataFrame:
    """rows with file_name: the zero-padded running number within each group."""
    number = F.lpad((F.col("__place") + 1).cast("string"), digits, "0")
    return placed(rows, by, order, window_rows).withColumn("file_name", F.concat(number, F.lit(".jpg"))).drop("__place", "__of")


def contiguous_parts(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """rows with part 1..parts, contiguous in order. Sizes differ by one at most.

    Ranges of the order column are counted first, so no task sees more than its own range. Their bounds are sampled anew each
    time that they are drawn, so the table is written once with the number of each row's range.
    """
    ranged = checkpointed(rows.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    ranged = ranged.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(order)))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    at = F.col("__before") + F.col("__i") - 1
    total = rows.agg(F.count("*").alias("__t"))
    size, rest = F.floor(F.col("__t") / parts), F.col("__t") % parts
    part = F.when(at < rest * (size + 1), F.floor(at / (size + 1)) + 1).otherwise(rest + F.floor((at - rest * (size + 1)) / F.greatest(size, F.lit(1))) + 1)
    joined = ranged.join(F.broadcast(before), "__p").crossJoin(F.broadcast(total))  # one row a partition, one row in all
    return joined.withColumn("part", part.cast("int")).drop("__p", "__i", "__before", "__t")


def override_frames(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Union by frame in which other's frames replace base's whole frames."""
    return base.join(other.select(*keys).distinct(), keys, "left_anti").unionByName(other)


def last_writer(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of each frame from its writer that comes last in order."""
    return rows.withColumn("__last", F.max(order).over(W.partitionBy(*keys))).where(F.col(order) == F.col("__last")).drop("__last")


def pick_one(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """One row by the hash of seed and key: a repeatable random choice."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(1)


def pair_distances(classes: DataFrame) -> DataFrame:
    """(a, b, distance) of every two of classes(k, hist), a < b; a class dimension, ten rows by default."""
    other = classes.select(F.col("k").alias("b"), F.col("hist").alias("hb"))
    pairs = classes.select(F.col("k").alias("a"), F.col("hist").alias("ha")).join(other, F.col("a") < F.col("b"))
    return pairs.select("a", "b", bhattacharyya(F.col("ha"), F.col("hb")).alias("distance"))


def farthest_triplet(distances: DataFrame) -> DataFrame:
    """(a, b, c, area) of the largest triangle; the first triplet among ties, none if there are fewer than three classes."""
    ab = distances.toDF("a", "b", "dab")
    triple = ab.join(distances.toDF("b", "c", "dbc"), "b").join(distances.toDF("a", "c", "dac"), ["a", "c"])
    sized = triple.withColumn("area", triangle_area(F.col("dab"), F.col("dbc"), F.col("dac"))).where("area is not null and area > 0")
    return sized.orderBy(F.round("area", 9).desc(), "a", "b", "c").limit(1).select("a", "b", "c", "area")


def closest_pairs(dark: DataFrame, bright: DataFrame, classes: list[int]) -> DataFrame:
    """(dark, bright, distance): the closest pair of two classes' medians; both tables are class dimensions."""
    a = dark.where(F.col("category").isin(classes)).select(F.col("category").alias("dark"), F.col("median").alias("ma"))
    b = bright.where(F.col("category").isin(classes)).select(F.col("category").alias("bright"), F.col("median").alias("mb"))
    pairs = a.join(F.broadcast(b), F.lit(True)).select("dark", "bright", bhattacharyya(F.col("ma"), F.col("mb")).alias("distance"))
    return pairs.orderBy(F.round("distance", 9), "dark", "bright").limit(1)


def rarest_class_first(predictions: DataFrame, referee: int = 0) -> DataFrame:
    """(old, category): new class numbers, the rarest class becoming the referee and the others following in order."""
    counts = predictions.groupBy("old").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.orderBy("n", "old")) - 1  # a class dimension
    rare = counts.withColumn("r", rank)
    follows = F.row_number().over(W.partitionBy(F.col("r") == 0).orderBy("old"))
    return rare.select("old", F.when(F.col("r") == 0, referee).otherwise(follows).cast("int").alias("category"))
