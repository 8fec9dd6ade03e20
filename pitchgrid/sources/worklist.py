"""Work lists, manifests of finished outputs, and stage paths."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.sources.pictures import list_files


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    """(path) of each non-empty line of a text file, trailing white space removed."""
    return spark.read.text(path).select(F.rtrim("value").alias("path")).where("path <> ''")


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose output isn't in the manifest."""
    return work.join(done.select(*keys), keys, "left_anti")


def frame_path(match: Column, half: Column, frame: Column) -> Column:
    """Path of a frame's picture; files count from 1."""
    return F.concat(match, F.lit("/"), half.cast("string"), F.lit("_HQ/frames/"), F.lpad((frame + 1).cast("string"), 5, "0"), F.lit(".jpg"))


#: Each stage and its output's file in a match's folder.
OUTPUTS = {"velocity": "velocity", "labels": "labels", "classification": "classification", "join": "results"}


def output_path(match: Column, stage: str) -> Column:
    """Where a stage's result of a match goes."""
    return F.concat(match, F.lit(f"/{OUTPUTS[stage]}"))


def count_files(listing: DataFrame, by: list[str]) -> DataFrame:
    """(by, n) files of each group of a listing."""
    return listing.groupBy(*by).agg(F.count("*").alias("n"))


def list_matches(spark: SparkSession, root: str, depth: int = 3, pattern: str = "*.json") -> DataFrame:
    """(match) of every folder that many levels below root with a file of the pattern; tasks list, no contents are read."""
    inner = F.regexp_extract(F.expr(f"substring(path, {len(root.rstrip('/')) + 1})"), f"^/((?:[^/]+/){{{depth}}})([^/]+)$", 1)
    named = list_files(spark, root, depth).where(F.regexp_extract("path", "([^/]+)$", 1).rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")))
    return named.select(F.rtrim(inner, F.lit("/")).alias("match")).where("match <> ''").distinct()
