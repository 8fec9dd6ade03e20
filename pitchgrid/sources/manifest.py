"""Results of stages that become visible whole: versioned folders, and a manifest that says which of them count.

A run writes its rows to a new folder and then appends one manifest row per half that it has worked on. Readers follow the
manifest, so a run that is lost before it publishes, or a half-written folder, is never seen; a second run finds what is left.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchgrid.sources.shared import checkpointed

KEYS = ["match", "half"]
MANIFEST = "stage string, match string, half int, version string, published timestamp"


def write_version(rows: DataFrame, root: str, stage: str) -> str:
    """rows (with match and half, neither null) in a folder of their own, by half; its version, which nothing reads until it is published."""
    version = uuid.uuid4().hex
    rows.repartition(*KEYS).write.partitionBy(*KEYS).parquet(f"{root}/{stage}/version={version}")
    return version


def publish(worked: DataFrame, root: str, stage: str, version: str) -> None:
    """Make a version count for the halves of worked, those without rows too. Each manifest row is right by itself, so a part of them does no harm."""
    entries = worked.select(F.col("match").cast("string"), F.col("half").cast("int")).distinct()
    entries = entries.select(F.lit(stage).alias("stage"), *KEYS, F.lit(version).alias("version"), F.current_timestamp().alias("published"))
    entries.write.mode("append").parquet(f"{root}/manifest")


def published(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """(match, half, version) of a stage: each half's last one."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:
        entries = spark.createDataFrame([], MANIFEST)
    last = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("published"), F.desc("version")))
    return entries.where(F.col("stage") == stage).withColumn("n", last).where("n = 1").select(*KEYS, "version")


def unfinished(work: DataFrame, root: str, stage: str) -> DataFrame:
    """The halves of work that no published version covers."""
    return work.join(published(work.sparkSession, root, stage), KEYS, "left_anti")


def read_published(spark: SparkSession, root: str, stage: str, schema: str) -> DataFrame:
    """Rows of the published versions; the join is on folders, so files of other versions can be pruned."""
    try:
        rows = spark.read.schema(f"{schema}, version string, match string, half int").parquet(f"{root}/{stage}")
    except AnalysisException:
        rows = spark.createDataFrame([], f"{schema}, version string, match string, half int")
    return rows.join(published(spark, root, stage), [*KEYS, "version"]).drop("version")


def run_stage(work: DataFrame, root: str, stage: str, compute) -> None:
    """Compute, write and publish what is unfinished; compute takes the halves left to do and gives their rows.

    These halves are written first, so that what is published is what was computed, whatever other runs publish meanwhile.
    """
    left = checkpointed(unfinished(work, root, stage).select(*KEYS))
    if not left.isEmpty():
        publish(left, root, stage, write_version(compute(left), root, stage))
