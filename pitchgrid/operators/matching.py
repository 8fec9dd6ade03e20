"""Correspondence of two sets of boxes per frame, and the joins built on it.

Boxes meet by an equi-join on the frame; the overlap is computed on the pairs of a frame only. Skewed frames are left to
adaptive execution: a frame holds the people in one picture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import iou

MIN_OVERLAP = 0.1


def best_overlaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, l, r, iou, n_left, n_right): each box of the smaller side with its best on the other, first index among ties.

    left has keys, l, lbox; right has keys, r, rbox. If the sides are equal in number, the left chooses. A box may be
    chosen more than once.
    """
    sizes = [x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((left, "n_left"), (right, "n_right"))]
    pairs = left.join(right, keys).join(sizes[0], keys).join(sizes[1], keys).withColumn("iou", iou(F.col("lbox"), F.col("rbox")))
    by_left = F.col("n_left") <= F.col("n_right")
    chooser, other = F.when(by_left, F.col("l")).otherwise(F.col("r")), F.when(by_left, F.col("r")).otherwise(F.col("l"))
    rank = F.row_number().over(W.partitionBy(*keys, chooser).orderBy(F.col("iou").desc(), other))
    return pairs.withColumn("rank", rank).where("rank = 1").select(*keys, "l", "r", "iou", "n_left", "n_right")


def iou_match(left: DataFrame, right: DataFrame, keys: list[str], min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Best overlaps strictly over min_overlap."""
    return best_overlaps(left, right, keys).where(F.col("iou") > min_overlap).select(*keys, "l", "r", "iou")


def mean_iou(spine: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], no_left: float = 3.0, one_empty: float = -1.0) -> DataFrame:
    """(keys, mean_iou) of every frame of spine; no_left without left boxes, one_empty if only the right has none."""
    means = best_overlaps(left, right, keys).groupBy(*keys).agg(F.avg("iou").alias("m"))
    seen = left.select(*keys).distinct().withColumn("seen", F.lit(True))
    joined = spine.select(*keys).join(seen, keys, "left").join(means, keys, "left")
    return joined.select(*keys, F.when(F.col("seen").isNull(), no_left).otherwise(F.coalesce("m", F.lit(one_empty))).alias("mean_iou"))


def suspicious_frames(left: DataFrame, right: DataFrame, keys: list[str], min_overlap: float = 0.3, min_ratio: float = 0.8) -> DataFrame:
    """Frames in which too few of the smaller side's boxes overlap well."""
    hits = best_overlaps(left, right, keys).groupBy(*keys, "n_left", "n_right").agg(F.count_if(F.col("iou") > min_overlap).alias("matched"))
    ratio = F.try_divide(F.col("matched"), F.least("n_left", "n_right"))
    return hits.withColumn("ratio", ratio).where(F.col("ratio") < min_ratio).select(*keys, "matched", "ratio")


def person_index(instances: DataFrame, keys: list[str], order: str, person_class: int = 0) -> DataFrame:
    """The people among the instances of each frame, numbered from 0 in order."""
    index = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return instances.where(F.col("class_id") == person_class).withColumn("person_idx", index)


def result_join(spine: DataFrame, people: DataFrame, velocity: DataFrame, teams: DataFrame, keys: list[str]) -> DataFrame:
    """One row per person with velocity and team scores; frames without people stay with nulls."""
    person = [*keys, "person_idx"]
    return spine.join(people, keys, "left").join(velocity, person, "left").join(teams, person, "left")


def isolated(keepers: DataFrame, others: DataFrame, keys: list[str], min_dist: float) -> DataFrame:
    """keepers(keys, idx, x, y) at least min_dist from everyone else of their frame; alone in a frame passes."""
    other = others.select(*keys, F.col("idx").alias("oidx"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    dist = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    near = keepers.join(other, keys).where("idx <> oidx").withColumn("d", dist).where(F.col("d") < min_dist).select(*keys, "idx").distinct()
    return keepers.join(near, [*keys, "idx"], "left_anti")
