"""Writers of stage results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(rows: DataFrame, path: str, by: tuple[str, ...] = ("match", "half")) -> None:
    """A stage's rows as Parquet by match and half; only the partitions written are replaced, so a stage can be resumed."""
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_split(rows: DataFrame, path: str) -> None:
    """Training rows by split and class, replacing all that was there."""
    rows.write.mode("overwrite").partitionBy("split", "category").parquet(path)


def gather_repaired(frames: DataFrame, repaired: DataFrame, keys: list[str]) -> DataFrame:
    """frames of all video frames, gathered by each repaired index into a new version; the source is left as it is."""
    index = repaired.select(*keys, F.col("frame_idx").alias("__to"), F.col("all_frame_idx").alias("frame_idx"))
    return frames.join(index, [*keys, "frame_idx"]).drop("frame_idx").withColumnRenamed("__to", "frame_idx")
