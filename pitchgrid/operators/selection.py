"""Filters on frames, people and class members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import area
from pitchgrid.functions.vectors import bhattacharyya


def small_players(boxes: DataFrame, calibration: DataFrame, keys: list[str], min_confidence: float, max_area: float, min_boxes: int = 1) -> DataFrame:
    """On-field boxes of well calibrated frames that have min_boxes of them or more and none over max_area."""
    known = calibration.where(F.col("confidence") >= min_confidence).select(*keys)
    on = boxes.where("onfield").join(known, keys, "left_semi")
    frames = on.groupBy(*keys).agg(F.max(area(F.col("bbox"))).alias("a"), F.count("*").alias("n"))
    return on.join(frames.where((F.col("a") <= max_area) & (F.col("n") >= min_boxes)), keys, "left_semi")


def far_from_goals(people: DataFrame, keys: list[str], min_dist: float) -> DataFrame:
    """People of the frames in which nobody is nearer than min_dist to a goal; people has goal_dist."""
    near = people.where(F.col("goal_dist") < min_dist).select(*keys).distinct()
    return people.join(near, keys, "left_anti")


def touchline_band(people: DataFrame, far: float | None, near: float | None) -> DataFrame:
    """People strictly between the two lines of the radar; a bound of 0 or None turns the filter off."""
    return people.where((F.col("radar_y") > far) & (F.col("radar_y") < near)) if far and near else people


def nearest_to_goal(people: DataFrame, keys: list[str], max_dist: float) -> DataFrame:
    """The person of each frame nearest to a goal, first index among ties, if within max_dist."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("goal_dist", "idx"))
    return people.withColumn("rank", rank).where((F.col("rank") == 1) & (F.col("goal_dist") <= max_dist)).drop("rank")


def near_class_median(members: DataFrame, medians: DataFrame, max_dist: float, only: int | None = None) -> DataFrame:
    """members(category, hist) within max_dist of their class's median histogram; only: filter this class alone.

    medians has one row per class, a handful by the data model, so it is broadcast.
    """
    joined = members.join(F.broadcast(medians.select("category", "median")), "category", "left")
    close = F.coalesce(bhattacharyya(F.col("hist"), F.col("median")) <= max_dist, F.lit(False))
    return joined.where(close if only is None else (F.col("category") != only) | close).drop("median")


def unlike_class(members: DataFrame, medians: DataFrame, classes: list[int], other: int, max_dist: float) -> DataFrame:
    """members without those of classes whose histogram is within max_dist of class other's median."""
    target = medians.where(F.col("category") == other).select(F.col("median").alias("__other"))
    joined = members.join(F.broadcast(target.limit(1)), how="left")
    like = F.coalesce(bhattacharyya(F.col("hist"), F.col("__other")) <= max_dist, F.lit(False))
    return joined.where(~(F.col("category").isin(classes) & like)).drop("__other")


def class_filter_with_fallback(members: DataFrame, medians: DataFrame, keepers: list[int], referee: int, max_dist: float) -> DataFrame:
    """near_class_median; if that leaves a keeper class empty, first drop keepers like referees and filter by new medians."""
    from pitchgrid.operators.aggregation import class_medians

    kept = near_class_median(members, medians, max_dist)
    present = kept.where(F.col("category").isin(keepers)).agg(F.count_distinct("category")).first()[0]
    if present == len(keepers):
        return kept
    cleaned = unlike_class(members, medians, keepers, referee, max_dist)
    return near_class_median(cleaned, class_medians(cleaned), max_dist)


def share_of_max(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """rows with share: score over the largest score of its class; null where that is not positive."""
    most = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.max(score).alias("__most"))  # one row a class
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    share = F.when(F.col("__most") > 0, F.col(score) / F.col("__most"))
    return rows.join(most, same).withColumn("share", share).drop("__most", *[f"__{c}" for c in by])


def min_max(rows: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """rows with value scaled to 0..1 by the table's least and largest; null if they are equal."""
    ends = rows.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return rows.crossJoin(F.broadcast(ends)).withColumn(out, F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def inside_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a point is strictly inside a polygon (array of x, y structs), by crossings of a ray."""
    n = F.size(polygon)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(polygon, i).alias("a"), F.get(polygon, F.when(i + 1 < n, i + 1).otherwise(0)).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.when(n > 2, F.size(F.filter(edges, crosses)) % 2 == 1).otherwise(F.lit(False))
