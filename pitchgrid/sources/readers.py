"""Readers of the files that a match's folder holds, with explicit schemas."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid import schema
from pitchgrid.functions.geometry import box, scaled_x, truncated_box
from pitchgrid.functions.pictures import decoded
from pitchgrid.sources.pictures import FILES_PER_TASK, frame_pictures, opened
from pitchgrid.sources.shared import spread

#: A batch of pixels is handed on at about this many bytes.
BATCH_BYTES = 8 << 20
#: How files of pictures begin: PNG, JPEG, GIF, BMP.
SIGNATURES = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF8", b"BM")
_FRAMES = pa.schema([("match", pa.string()), *[(c, pa.int32()) for c in ("half", "frame_idx", "height", "width")], ("data", pa.binary())])


def _json(spark: SparkSession, path: str | list[str], ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _named(df: DataFrame) -> DataFrame:
    """df with match and half from the file's path .../match/{half}_name.json."""
    path = F.input_file_name()
    half = F.regexp_extract(path, r"/(\d)_[^/]*$", 1)
    return df.withColumn("match", F.url_decode(F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1))).withColumn("half", half.cast("int"))


def read_detections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per detected box."""
    frames = _named(_json(spark, path, schema.DETECTIONS_JSON)).select("match", "half", F.posexplode("predictions").alias("frame_idx", "f"))
    each = frames.select("match", "half", "frame_idx", F.posexplode(F.arrays_zip("f.bboxes", "f.onfield")).alias("det_idx", "d"))
    return each.select("match", "half", "frame_idx", "det_idx", box(*[F.col("d.bboxes")[i] for i in range(4)]).alias("bbox"), F.col("d.onfield").alias("onfield"))


def read_calibration(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per frame; the first of a frame's calibrations counts."""
    frames = _named(_json(spark, path, schema.CALIBRATION_JSON)).select("match", "half", F.posexplode("predictions").alias("frame_idx", "f"))
    return frames.select("match", "half", "frame_idx", F.get("f", F.lit(0))["confidence"].alias("confidence"), F.get("f", F.lit(0))["homography"].alias("homography"))


def read_flow_counts(spark: SparkSession, path: str) -> DataFrame:
    """(match_path, half, n_flow) from a table with one column per half."""
    wide = spark.read.schema(schema.FLOW_COUNTS).option("header", True).option("mode", "FAILFAST").csv(path)
    return wide.selectExpr("match_path", "stack(2, 1, num_frames_first_half, 2, num_frames_second_half) as (half, n_flow)")


def ratio(text: Column) -> Column:
    """The value of 'a:b', divided from the left; N/A counts as 1:1."""
    parts = F.transform(F.split(F.coalesce(F.nullif(text, F.lit("N/A")), F.lit("1:1")), ":"), lambda x: x.cast("double"))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(parts, F.lit(0)), lambda a, b: F.try_divide(a, b))


def read_aspect_ratios(spark: SparkSession, path: str) -> DataFrame:
    """(match_path, sar)."""
    rows = spark.read.schema(schema.ASPECT_RATIOS).option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.select("match_path", ratio(F.col("SAR")).alias("sar"))


def scaled_detections(detections: DataFrame, ratios: DataFrame) -> DataFrame:
    """detections with boxes in display pixels: x stretched by their match's ratio where that is over 1, all truncated.

    ratios has (match_path, sar), as read_aspect_ratios gives it; detections have match. Matches without a ratio are left out.
    """
    joined = detections.join(ratios.withColumnRenamed("match_path", "match"), "match")
    b = F.col("bbox")
    wide = box(scaled_x(b["x1"], F.col("sar")), b["y1"], scaled_x(b["x2"], F.col("sar")), b["y2"])
    return joined.withColumn("bbox", truncated_box(wide, F.lit(1.0), F.lit(1.0))).drop("sar")


def read_segmentation(spark: SparkSession, path: str, min_score: float | None = None, person_only: bool = False) -> DataFrame:
    """Instances stored as Parquet; strictly over min_score, people alone if asked. Both filters reach the scan."""
    rows = spark.read.schema(schema.SEGMENTATION).parquet(path)
    rows = rows.where("class_id = 0") if person_only else rows
    return rows if min_score is None else rows.where(F.col("score") > min_score)


def read_frames(listing: DataFrame) -> DataFrame:
    """(match, half, frame_idx, height, width, data) of the frames of a listing of pictures; data is BGR by row. Files that are no pictures are left out.

    The task that holds a frame's path opens it, so the number of tasks follows the number of frames.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                data = opened(row.pop("rgb"))
                try:
                    image = decoded(data) if data.startswith(SIGNATURES) else None
                except (zlib.error, struct.error, KeyError):  # cut off
                    image = None
                if image is not None:
                    rows.append(row | {"height": image.shape[0], "width": image.shape[1], "data": (image[..., ::-1] if image.ndim == 3 else image).tobytes()})
                    held += image.size
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _FRAMES)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FRAMES)

    return spread(frame_pictures(listing), FILES_PER_TASK).mapInArrow(decode, "match string, half int, frame_idx int, height int, width int, data binary")


def frame_size(listing: DataFrame) -> DataFrame:
    """(match, half, height, width) of each half's first frame, the only one that is opened."""
    first = listing.where("series = 'frames'").groupBy("match", "half").agg(F.min_by(F.struct("number", "path"), "number").alias("f"))
    firsts = first.select("match", "half", F.lit("frames").alias("series"), "f.*")
    return read_frames(firsts).select("match", "half", "height", "width")
