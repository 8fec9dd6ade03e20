"""The stages of a match from files to the joined result, each published by half and taken up where the last run ended.

Work is a table of (match, half). A stage does the halves of it that its inputs' published versions cover and its own don't,
so any stage can be run again, alone or by ``run_match``, and a lost run leaves nothing that a reader sees. Pictures stay
files: stages move their paths, and the task that needs one opens it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid import schema
from pitchgrid.functions import pixels
from pitchgrid.functions.pictures import decoded
from pitchgrid.operators import matching
from pitchgrid.plans.config import LabelConfig, VelocityConfig
from pitchgrid.plans.velocity import half_velocities
from pitchgrid.sources import manifest
from pitchgrid.sources.pictures import HALF, frame_pictures, opened

FRAME = ["match", "half", "frame_idx"]
SEGMENTATION, VELOCITY, TEAMS, RESULT = "segmentation", "velocity", "teams", "result"
RESULT_COLUMNS = f"frame_idx int, person_idx int, score float, bbox {schema.BOX}, vx double, vy double, logits array<float>"
HISTOGRAM = "match string, half int, frame_idx int, person_idx int, hist array<double>"
_HISTOGRAM = pa.schema([("match", pa.string()), *[(c, pa.int32()) for c in ("half", "frame_idx", "person_idx")], ("hist", pa.list_(pa.float64()))])


def _columns(ddl: str) -> str:
    """The columns of a stage's table without those that name its half."""
    return ddl.replace("match string, half int, ", "", 1)


def of_halves(rows: DataFrame, halves: DataFrame) -> DataFrame:
    return rows.join(halves.select(*HALF), HALF, "left_semi")


def ready(work: DataFrame, root: str, *needs: str) -> DataFrame:
    """The halves of work whose inputs are all published; the others wait for a later run."""
    for stage in needs:
        work = of_halves(work, manifest.published(work.sparkSession, root, stage))
    return work


def published_people(work: DataFrame, root: str, min_score: float | None = None) -> DataFrame:
    """(match, half, frame_idx, person_idx, score, bbox, mask) of the published instances of work's halves, people numbered within their frames."""
    rows = of_halves(manifest.read_published(work.sparkSession, root, SEGMENTATION, _columns(schema.SEGMENTATION)), work)
    rows = rows if min_score is None else rows.where(F.col("score") > min_score)
    people = matching.person_index(rows, FRAME, "seg_idx")
    return people.select(*FRAME, F.col("person_idx").cast("int").alias("person_idx"), "score", "bbox", "mask")


def segmentation_stage(work: DataFrame, root: str, instances: DataFrame) -> None:
    """instances (the columns of a segmentation) of a network that runs elsewhere become the stage's result."""
    rows = lambda left: of_halves(instances.to(work.sparkSession.createDataFrame([], schema.SEGMENTATION).schema), left)
    manifest.run_stage(work, root, SEGMENTATION, rows)


def velocity_stage(
    work: DataFrame, root: str, listing: DataFrame, counts: DataFrame, sizes: DataFrame, options: VelocityConfig = VelocityConfig(),
    repaired: DataFrame | None = None, with_overlays: bool = True,
) -> None:
    """Velocities of the published people, from the listed pictures of the halves that are left."""

    def compute(left: DataFrame) -> DataFrame:
        rows = half_velocities(published_people(left, root).drop("score"), of_halves(listing, left), counts, of_halves(sizes, left), options, repaired, with_overlays)
        return rows.select(*FRAME, "person_idx", "vx", "vy")

    manifest.run_stage(ready(work, root, SEGMENTATION), root, VELOCITY, compute)


def person_histograms(people: DataFrame, listing: DataFrame, options: LabelConfig = LabelConfig()) -> DataFrame:
    """(match, half, frame_idx, person_idx, hist): colours within each person's outline, its edge left out, or in the whole box if it has none.

    People of one frame are histogrammed together, so its picture is opened once; a frame without a picture is left out.
    """
    grouped = people.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("person_idx", "bbox", "mask"))).alias("people"))
    named = grouped.join(frame_pictures(listing), FRAME)
    kind, radius = options.histogram, options.erosion_radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                rgb, out = decoded(opened(row["rgb"])), []
                for p in row["people"]:
                    cut = pixels.patch(rgb, [p["bbox"][c] for c in ("x1", "y1", "x2", "y2")], copy=False)
                    lines = [np.array([(q["x"], q["y"]) for q in line]) for line in p["mask"] or []]
                    hist = pixels.body_histogram(cut, lines, radius, kind=kind) if lines else pixels.colour_histogram(cut, np.ones(cut.shape[:2], bool), kind)
                    out.append({c: row[c] for c in FRAME} | {"person_idx": p["person_idx"], "hist": hist.astype(float).tolist()})
                yield pa.RecordBatch.from_pylist(out, _HISTOGRAM)

    return named.select(*FRAME, "rgb", "people").mapInArrow(run, HISTOGRAM)


def linear_scores(x: Column, weights: np.ndarray) -> Column:
    """The score of each class: classes x (features + 1) weights, the intercepts last."""
    row = lambda w: F.aggregate(F.zip_with(x, F.lit(w[:-1].tolist()), lambda a, b: a * b), F.lit(float(w[-1])), lambda a, b: a + b)
    return F.array(*[row(w) for w in weights])


def team_stage(work: DataFrame, root: str, listing: DataFrame, weights: np.ndarray, options: LabelConfig = LabelConfig()) -> None:
    """Team scores of the published people by a classifier's weights over their colours (see ``models.epochs``)."""

    def compute(left: DataFrame) -> DataFrame:
        rows = person_histograms(published_people(left, root), of_halves(listing, left), options)
        return rows.select(*FRAME, "person_idx", linear_scores(F.col("hist"), weights).cast("array<float>").alias("logits"))

    manifest.run_stage(ready(work, root, SEGMENTATION), root, TEAMS, compute)


def join_stage(work: DataFrame, root: str, sizes: DataFrame) -> None:
    """One row per published person with velocity and team scores, and one for each of a half's frames without people."""

    def compute(left: DataFrame) -> DataFrame:
        spark = left.sparkSession
        spine = of_halves(sizes, left).where("n_frames > 0").select(*HALF, F.explode(F.sequence(F.lit(0), F.col("n_frames").cast("int") - 1)).alias("frame_idx"))
        velocity, teams = (of_halves(manifest.read_published(spark, root, stage, _columns(ddl)), left) for stage, ddl in ((VELOCITY, schema.VELOCITY), (TEAMS, schema.TEAM_SCORES)))
        rows = matching.result_join(spine, published_people(left, root).drop("mask"), velocity, teams, FRAME)
        return rows.select(*FRAME, "person_idx", "score", "bbox", "vx", "vy", "logits")

    manifest.run_stage(ready(work, root, SEGMENTATION, VELOCITY, TEAMS), root, RESULT, compute)


def results(work: DataFrame, root: str) -> DataFrame:
    """The published results of work's halves."""
    rows = of_halves(manifest.read_published(work.sparkSession, root, RESULT, RESULT_COLUMNS), work)
    return rows.select(*FRAME, "person_idx", "score", "bbox", "vx", "vy", "logits")


def run_match(
    work: DataFrame, root: str, instances: DataFrame, listing: DataFrame, counts: DataFrame, sizes: DataFrame, weights: np.ndarray,
    velocity: VelocityConfig = VelocityConfig(), labels: LabelConfig = LabelConfig(), repaired: DataFrame | None = None, with_overlays: bool = True,
) -> DataFrame:
    """All stages of work's halves that aren't published yet, then their joined results."""
    segmentation_stage(work, root, instances)
    velocity_stage(work, root, listing, counts, sizes, velocity, repaired, with_overlays)
    team_stage(work, root, listing, weights, labels)
    join_stage(work, root, sizes)
    return results(work, root)
