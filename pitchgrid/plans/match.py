"""Stages of a match as DataFrame pipelines: blobs, labels, velocities and the joined result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.functions import geometry as G
from pitchgrid.functions import pixels
from pitchgrid.operators import aggregation, matching, ranking, selection
from pitchgrid.operators.motion import relative_velocity

FRAME = ["match", "half", "frame_idx"]
_KEY = [("match", pa.string()), ("half", pa.int32()), ("frame_idx", pa.int32())]
VECTORS = pa.schema([*_KEY, ("person_idx", pa.int32()), ("u", pa.float64()), ("v", pa.float64())])
HISTOGRAMS = pa.schema([*_KEY, ("det_idx", pa.int32()), ("hist", pa.list_(pa.float64()))])


def _polygons(mask: list) -> list[np.ndarray]:
    return [np.array([(q["x"], q["y"]) for q in poly]) for poly in mask]


def located(detections: DataFrame, calibration: DataFrame) -> DataFrame:
    """On-pitch position of each detection: radar_x, radar_y and goal_dist."""
    joined = detections.join(calibration.select(*FRAME, "homography"), FRAME)
    x, y = G.unproject(F.col("homography"), *G.foot_point(F.col("bbox")))
    rx, ry = G.radar(x, y)
    out = joined.withColumns({"radar_x": rx, "radar_y": ry}).drop("homography")
    return out.withColumn("goal_dist", G.goal_distance(F.col("radar_x"), F.col("radar_y")))


def midfield(detections: DataFrame, calibration: DataFrame, min_confidence=0.75, max_area=40000.0, min_goal_dist=20.0, far=3.0, near=29.0) -> DataFrame:
    """Detections of frames without small or goal-side players, between the touchlines."""
    small = selection.small_players(detections, calibration, FRAME, min_confidence, max_area)
    return selection.touchline_band(selection.far_from_goals(located(small, calibration), FRAME, min_goal_dist), far, near)


def blobs(detections: DataFrame, instances: DataFrame, min_score=0.65, min_area=1000.0) -> DataFrame:
    """Detections with the mask of the person instance that overlaps them best."""
    people = instances.where((F.col("class_id") == 0) & (F.col("score") > min_score))
    left = detections.select(*FRAME, F.col("det_idx").alias("l"), F.col("bbox").alias("lbox"))
    right = people.select(*FRAME, F.col("seg_idx").alias("r"), F.col("bbox").alias("rbox"))
    pairs = matching.iou_match(left, right, FRAME).select(*FRAME, F.col("l").alias("det_idx"), F.col("r").alias("seg_idx"))
    masks = people.select(*FRAME, "seg_idx", F.col("bbox").alias("mask_bbox"), "mask")
    joined = detections.join(pairs, [*FRAME, "det_idx"]).join(masks, [*FRAME, "seg_idx"])
    return joined.where(G.area(F.col("bbox")) >= min_area)


def with_histograms(rows: DataFrame, frames: DataFrame, kind: str = "ab", radius: int = 2, part: str = "all") -> DataFrame:
    """rows with hist: the colour histogram of each person, cut from its frame's picture. One picture crosses per frame."""
    grouped = rows.groupBy(*FRAME).agg(F.collect_list(F.struct("det_idx", "mask_bbox", "mask")).alias("people"))
    joined = grouped.join(frames, FRAME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                rgb = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 3)[..., ::-1]
                out = []
                for p in row["people"]:
                    cut = pixels.patch(rgb, [p["mask_bbox"][c] for c in ("x1", "y1", "x2", "y2")], copy=False)
                    hist = pixels.body_histogram(cut, _polygons(p["mask"]), radius, part, kind)
                    out.append({**{k: row[k] for k in FRAME}, "det_idx": p["det_idx"], "hist": hist.tolist()})
                yield pa.RecordBatch.from_pylist(out, HISTOGRAMS)

    hists = joined.select(*FRAME, "people", "height", "width", "data").mapInArrow(run, "match string, half int, frame_idx int, det_idx int, hist array<double>")
    return rows.join(hists, [*FRAME, "det_idx"])


def goalkeepers(people: DataFrame, side: int, max_goal_dist=5.0, min_dist=2.5) -> DataFrame:
    """The isolated nearest person to the goal that keeper side (0 or 1) guards in each half; people from located()."""
    gx = F.when((F.col("half") - 1 + side) % 2 == 0, G.GOALS[0][0]).otherwise(G.GOALS[1][0])
    own = F.sqrt((F.col("radar_x") - gx) * (F.col("radar_x") - gx) + (F.col("radar_y") - G.GOALS[0][1]) * (F.col("radar_y") - G.GOALS[0][1]))
    named = people.withColumns({"goal_dist": own, "idx": F.col("det_idx"), "x": F.col("radar_x"), "y": F.col("radar_y")})
    near = selection.nearest_to_goal(named, FRAME, max_goal_dist)
    return matching.isolated(near, named, FRAME, min_dist).withColumn("category", F.lit(3 + side))


def keepers_of_both_sides(people: DataFrame, **options) -> DataFrame:
    """Both keepers; in a frame with both, the second replaces the first."""
    both = goalkeepers(people, 0, **options).unionByName(goalkeepers(people, 1, **options))
    return ranking.last_writer(both, FRAME, "category")


def preliminary_labels(midfielders: DataFrame, keepers: DataFrame, max_dist: float = 0.4) -> DataFrame:
    """Labelled players of both kinds, keepers' frames replacing midfield frames, filtered by class medians."""
    labels = ranking.override_frames(midfielders, keepers, FRAME)
    return selection.class_filter_with_fallback(labels, aggregation.class_medians(labels), [3, 4], 0, max_dist)


def person_vectors(frames: DataFrame) -> DataFrame:
    """Flow vectors of the pixels of each person's polygons.

    frames has one row per frame: match, half, frame_idx, height, width, u, v (bytes of the flow pictures) and people, an
    array of person_idx and mask in flow pixels. A pixel that two polygons of a person share counts twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shape = (row["height"], row["width"])
                flow = pixels.dequantized(*(np.frombuffer(row[x], np.uint8).reshape(shape) for x in "uv"))
                for p in row["people"]:
                    uv = flow[pixels.indices(_polygons(p["mask"]), shape)].astype(float)
                    key = [pa.array([row[k]] * len(uv), VECTORS.field(k).type) for k in FRAME] + [pa.array([p["person_idx"]] * len(uv), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*key, pa.array(uv[:, 0]), pa.array(uv[:, 1])], schema=VECTORS)

    return frames.select(*FRAME, "height", "width", "u", "v", "people").mapInArrow(run, "match string, half int, frame_idx int, person_idx int, u double, v double")


def velocities(people: DataFrame, field: DataFrame) -> DataFrame:
    """Velocity of each person relative to the field, from flow vectors."""
    return relative_velocity(people, field, FRAME, "person_idx")
