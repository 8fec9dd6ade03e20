"""Re-alignment of detection frames to video frames by a sequential window search.

The search carries a window from one detection frame to the next. Only that is done in order: all scores are computed ahead by
Spark, for a band of video frames around the place where each detection frame is expected. A fold then walks the scores of a
half until its window leaves the bands, and the next round lays bands around the place that it reached.

A small half (``BUDGET`` frames and ``WHOLE`` boxes at most) is scored where it is folded: its boxes are far fewer bytes than its scores,
which are neither shuffled nor written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchgrid.sources.shared import checkpointed, discard, in_small_batches, stored

GOOD_ENOUGH, MAX_WIDENINGS, NO_DETECTIONS, ONE_EMPTY = 0.5, 30, 3.0, -1.0

#: Half steps that a band reaches beyond the expected window on each side, in the first round.
MARGIN = 4
#: A round asks for as many frames of a half as their bands hold so many scores for each video frame, and for one at least.
BUDGET = 128
#: A half of BUDGET frames or fewer that has no more boxes than this, on both sides together, is scored and folded by one task.
WHOLE = 4096
#: Overlaps that are held at a time for such a half, but those of a detection frame at least.
CELLS = 1 << 18
#: Video frames in a tile; bands meet the frames of the tiles that they touch.
TILE = 64
#: Each level's bands reach four times as far as those of the level before.
MAX_LEVEL = 12

EDGES = ("x1", "y1", "x2", "y2")
_STATE = "half_id string, n bigint, m bigint, at bigint, low bigint, high bigint, level int"
_FOUND = f"{_STATE}, since bigint, frames array<bigint>, scores array<double>"
_FOLDED = pa.schema([
    ("half_id", pa.string()), *[(c, pa.int64()) for c in ("n", "m", "at", "low", "high")], ("level", pa.int32()), ("since", pa.int64()), ("frames", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))
])


def boxes_by_frame(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, half_id, frame_idx, boxes) of every frame from 0 on; boxes with a null edge are left out, their frames stay.

    half_id names the values of keys and isn't null where they are.
    """
    whole = F.col("bbox").isNotNull()
    for edge in EDGES:
        whole = whole & F.col(f"bbox.{edge}").isNotNull()
    named = rows.select(*keys, F.col("frame_idx").cast("bigint").alias("frame_idx"), F.when(whole, F.col("bbox")).alias("bbox"))
    frames = named.where("frame_idx >= 0").groupBy(*keys, "frame_idx").agg(F.collect_list("bbox").alias("boxes"))
    return frames.select(*keys, F.to_json(F.struct(*keys)).alias("half_id"), "frame_idx", "boxes")


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The overlap of each of the boxes a with each of the boxes b, as ``geometry.iou``; 0 where the union is empty."""
    x1, y1, x2, y2 = a[:, None, 0], a[:, None, 1], a[:, None, 2], a[:, None, 3]
    wide = np.maximum(np.fmin(x2, b[:, 2]) - np.maximum(x1, b[:, 0]) + 1, 0)
    wide *= np.maximum(np.fmin(y2, b[:, 3]) - np.maximum(y1, b[:, 1]) + 1, 0)
    union = (x2 - x1 + 1) * (y2 - y1 + 1) + (b[:, 2] - b[:, 0] + 1) * (b[:, 3] - b[:, 1] + 1) - wide
    return np.divide(wide, union, out=np.zeros_like(wide), where=union != 0)


def frame_scores(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """The score of each frame of boxes a with each of boxes b; sizes tell how many boxes each frame has, none has 0."""
    o = _overlaps(a, b)
    at, bt = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    of_a = np.add.reduceat(np.maximum.reduceat(o, bt, axis=1), at, axis=0) / a_sizes[:, None]
    of_b = np.add.reduceat(np.maximum.reduceat(o, at, axis=0), bt, axis=1) / b_sizes
    return np.floor(np.where(a_sizes[:, None] <= b_sizes, of_a, of_b) * 1e9 + 0.5) / 1e9  # 9 digits, halves up


def _frames_of(frames: pa.ListArray) -> Iterator[tuple]:
    """(frames, boxes, their number by frame) of each list of frames that have boxes."""
    each = frames.values
    boxes = each.field("boxes")
    sides = np.column_stack([boxes.values.field(c).to_numpy(zero_copy_only=False) for c in EDGES])
    ends, at = boxes.offsets.to_numpy(), frames.offsets.to_numpy()
    for low, high in zip(at[:-1], at[1:], strict=True):
        yield each.slice(low, high - low), sides[ends[low] : ends[high]], np.diff(ends[low : high + 1])


def _score_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [[], [], [], []]
        for (bands, a, a_sizes), (tile, b, b_sizes) in zip(_frames_of(batch.column("bands")), _frames_of(batch.column("tiled")), strict=True):
            video, frame, first, beyond = tile.field("frame_idx").to_numpy(), *[bands.field(c).to_numpy()[:, None] for c in ("frame_idx", "first", "beyond")]
            at, of = np.nonzero((video >= first) & (video < beyond))
            scores = frame_scores(a, a_sizes, b, b_sizes)[at, of]
            for column, values in zip(columns, (frame[at, 0], video[of], scores, np.unique(frame[at[scores >= GOOD_ENOUGH], 0])), strict=True):
                column.append(values)
        ends = [np.cumsum([0, *map(len, c)]).astype(np.int32) for c in columns]
        lists = [pa.ListArray.from_arrays(e, np.concatenate(c)) for e, c in zip(ends, columns, strict=True) if len(c)]
        if lists:
            yield pa.RecordBatch.from_arrays([batch.column("half_id"), *lists], ["half_id", "frames", "video", "scores", "good"])


def _tile_scores(bands: DataFrame, video: DataFrame) -> DataFrame:
    """(half_id, frames, video, scores, good): for a tile of video frames and some bands, each pair's frames and score in three arrays, and the frames with a good enough one.

    A row that is scored holds at most TILE frames of either side, so neither a long half nor a busy one meets in one task.
    """
    left = bands.where("first < beyond and size(boxes) > 0").withColumn("tile", F.explode(F.expr(f"sequence(first div {TILE}, (beyond - 1) div {TILE})")))
    # scoring costs far more than a row's bytes, so partitions must not be merged by size; both groupings keep the join's
    parts = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.repartition(parts, "half_id", "tile").groupBy("half_id", "tile", F.expr(f"frame_idx div {TILE}"))
    left = left.agg(F.collect_list(F.struct("frame_idx", "first", "beyond", "boxes")).alias("bands"))
    right = video.where("size(boxes) > 0").groupBy("half_id", F.expr(f"frame_idx div {TILE}").alias("tile")).agg(F.collect_list(F.struct("frame_idx", "boxes")).alias("tiled"))
    pairs = in_small_batches(left.join(right, ["half_id", "tile"]).select("half_id", "bands", "tiled"))
    return pairs.mapInArrow(_score_tiles, "half_id string, frames array<bigint>, video array<bigint>, scores array<double>, good array<bigint>")


def band_scores(bands: DataFrame, video: DataFrame) -> DataFrame:
    """(half_id, frame_idx, video_idx, score) of each band's frame with the video frames that have boxes.

    The score is the mean of the best overlaps of the side with fewer boxes (the band's, if equal); it has 9 digits, so that the
    order of addition is no matter. A box with an empty union overlaps by 0.

    bands has half_id, frame_idx, boxes, first and beyond (exclusive). The join is by the half and a tile of video frames, and
    a task scores the frames of a tile at a time, as matrices; no row is made of a pair of boxes.
    """
    each = _tile_scores(bands, video).select("half_id", F.explode(F.arrays_zip("frames", "video", "scores")).alias("s"))
    return each.select("half_id", F.col("s.frames").alias("frame_idx"), F.col("s.video").alias("video_idx"), F.col("s.scores").alias("score"))


@dataclass
class Search:
    """A window [low, high) over n video frames that follows the detections; it grows by half a step a side at a time."""

    n: int
    step: int
    low: int
    high: int

    def rings(self) -> Iterator[list[int]]:
        """Frames in the window, then those that each widening opens at its two sides; ends where none are opened."""
        opened = list(range(self.low, self.high))
        while opened:
            yield opened
            left, right = max(self.low - self.step // 2, 0), min(self.high + self.step // 2, self.n)
            opened = [*range(left, self.low), *range(self.high, right)]
            self.low, self.high = left, right

    def advance(self, score: Callable[[int], float]) -> tuple[int, float]:
        """The first ring's best frame that is good enough, or else the best of all rings; the window moves past it."""
        frame, best = -1, -np.inf
        for ring in islice(self.rings(), MAX_WIDENINGS):
            frame, best = max([(frame, best), *((i, score(i)) for i in ring)], key=lambda x: x[1])
            if best >= GOOD_ENOUGH:
                break
        self.low, self.high = max(frame + self.step // 4, 0), min(frame + ceil(4 * self.step / 5), self.n)
        return frame, best

    def skip(self) -> tuple[int, float]:
        """The answer for a frame without detections; the window reaches further for the next."""
        self.high = min(self.low + 10 * self.step, self.n)
        return self.low + self.step // 2, NO_DETECTIONS


class Unknown(Exception):
    """A score outside the band was asked for."""


def _score(first: int, beyond: int, known: dict) -> Callable[[int], float]:
    """Look-up of a frame's scores; a video frame within the band but without a score has no boxes."""

    def score(i: int) -> float:
        if not first <= i < beyond:
            raise Unknown
        return known.get(i, ONE_EMPTY)

    return score


def _fold(states: pa.Table, rows: pa.Table) -> pa.Table:
    """A half's next state, and (frame, overlap) of the frames settled on the way."""
    s = states.to_pylist()[0]
    n, m, at, level = s["n"], s["m"], s["at"], s["level"]
    marks = rows.select(["frame_idx", "first", "beyond"]).filter(rows.column("frame_idx").is_valid()).to_pylist()
    bands = {b["frame_idx"]: (b["first"], b["beyond"]) for b in marks}
    frames, video, scores = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("frames", "video", "scores"))
    order = np.argsort(frames, kind="stable")
    frames, video, scores = frames[order], video[order], scores[order]
    window = Search(m, 2 * m // n, s["low"], s["high"])
    asked, found = s["asked"], []
    for frame in range(at, at + asked):
        low, high = window.low, window.high
        try:
            if frame in bands:
                i, j = np.searchsorted(frames, [frame, frame + 1])
                found.append(window.advance(_score(*bands[frame], dict(zip(video[i:j].tolist(), scores[i:j].tolist(), strict=True)))))
            else:
                found.append(window.skip())
        except Unknown:
            window.low, window.high = low, high
            break
    if len(found) < asked / 2:
        level = min(level + 1, MAX_LEVEL)
    elif len(found) == asked:
        level = max(level - 1, 0)
    row = (s["half_id"], n, m, at + len(found), window.low, window.high, level, at, [f for f, _ in found], [float(b) for _, b in found])
    return pa.Table.from_pylist([dict(zip(_FOLDED.names, row, strict=True))], _FOLDED)


def _sides(rows: pa.Table) -> tuple:
    """(frames, boxes, their number by frame) of rows(frame_idx, boxes) that have boxes, by frame."""
    rows = rows.select(["frame_idx", "boxes"]).sort_by("frame_idx").combine_chunks()
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros(0, np.int64)
    boxes = rows.column("boxes").chunk(0)
    edges = boxes.flatten()
    return rows.column("frame_idx").to_numpy(), np.column_stack([edges.field(c).to_numpy(zero_copy_only=False) for c in EDGES]), np.diff(boxes.offsets.to_numpy())


def _whole_scores(detected: tuple, video: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """(frame, its scores with each frame of video) of each detection frame, scored so many at a time that CELLS overlaps are held or few more."""
    (frames, a, sizes), (_, b, b_sizes) = detected, video
    ends = np.cumsum(sizes)
    at = 0
    while at < len(frames):
        first = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, first + CELLS // max(len(b), 1), "right")))
        if len(b):
            scores = frame_scores(a[first : ends[to - 1]], sizes[at:to], b, b_sizes)
        else:
            scores = np.zeros((to - at, 0))
        yield from zip(frames[at:to].tolist(), scores, strict=True)
        at = to


def _search(states: pa.Table, rows: pa.Table) -> pa.Table:
    """As ``_fold``, of a small half whose rows are the frames of both sides with their boxes."""
    s = states.to_pylist()[0]
    of_video = rows.column("of_video")
    detected, video = _sides(rows.filter(pc.invert(of_video))), _sides(rows.filter(of_video))
    known = dict(_whole_scores(detected, video))
    window, at, found = Search(s["m"], 2 * s["m"] // s["n"], s["low"], s["high"]), video[0].tolist(), []
    for frame in range(s["n"]):
        if frame in known:
            found.append(window.advance(_score(0, s["m"], dict(zip(at, known[frame].tolist(), strict=True)))))
        else:
            found.append(window.skip())
    row = (s["half_id"], s["n"], s["m"], s["n"], window.low, window.high, s["level"], 0, [f for f, _ in found], [float(b) for _, b in found])
    return pa.Table.from_pylist([dict(zip(_FOLDED.names, row, strict=True))], _FOLDED)


def _searched(states: DataFrame, detected: DataFrame, video: DataFrame) -> DataFrame:
    """What a fold finds for small halves. Their boxes are shuffled once, and their scores not at all."""
    sides = [t.where(F.size("boxes") > 0).select("half_id", "frame_idx", "boxes", F.lit(v).alias("of_video")) for t, v in ((detected, False), (video, True))]
    # as for tiles, partitions must not be merged by size; the join and the groups keep these
    parts = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sides[0].unionByName(sides[1]).repartition(parts, "half_id").join(states.select("half_id").hint("merge"), "half_id", "left_semi").withColumnRenamed("half_id", "half")
    return states.drop("boxes").groupBy("half_id").cogroup(rows.groupBy("half")).applyInArrow(_search, _FOUND)


def _rounds(states: DataFrame) -> DataFrame:
    """states with half_step, margin (video frames beyond the window) and asked, the frames that this round asks for.

    A half of no more than BUDGET frames asks for all of them with all of its video, which is within the budget, so it needs one round.
    """
    out = states.withColumn("half_step", F.expr("2 * m div n div 2"))
    out = out.withColumn("margin", F.expr(f"if(n <= {BUDGET}, m, least(half_step * {MARGIN} * shiftleft(1L, 2 * level), m))"))
    width = "least(2 * margin + 2 * half_step + 1, m + 1)"
    return out.withColumn("asked", F.expr(f"if(n <= {BUDGET}, n - at, least(greatest({BUDGET} * m div {width}, 1L), n - at))"))


def _with_gaps(detected: DataFrame) -> DataFrame:
    """(half_id, frame_idx, boxes, missed) of the frames with boxes; missed counts the frames without any right before. Only numbers are sorted by half."""
    some = detected.where(F.size("boxes") > 0).select("half_id", "frame_idx", "boxes")
    before = F.lag("frame_idx", 1, -1).over(W.partitionBy("half_id").orderBy("frame_idx"))
    gaps = some.select("half_id", "frame_idx", (F.col("frame_idx") - before - 1).alias("missed"))
    return some.join(gaps, ["half_id", "frame_idx"])


def _bands(rounds: DataFrame, detected: DataFrame) -> DataFrame:
    """Bands of the frames that are asked for in this round, with the bounds (least, most) of what a search can reach at all."""
    frames = rounds.withColumn("frame_idx", F.explode(F.expr("sequence(at, at + asked - 1)")))
    low = F.col("low") + F.expr("(frame_idx - at) * m div n")
    # a window that has passed frames without detections has stayed behind and reaches further
    missed = F.least(F.col("missed"), F.col("frame_idx") - F.col("at"))
    low = low - F.when(missed > 0, F.expr("missed * m div n + 1")).otherwise(0)
    wide = F.col("high") - F.col("low")
    usual = F.when(missed > 0, F.expr("10 * (2 * m div n)")).otherwise(2 * F.col("half_step"))
    high = low + F.when(F.col("frame_idx") == F.col("at"), wide).otherwise(F.greatest(wide, usual))
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), F.col("m"))
    bounds = {}
    for names, by in ((("first", "beyond"), F.col("margin")), (("least", "most"), F.col("margin") + MAX_WIDENINGS * F.col("half_step"))):
        bounds |= dict(zip(names, (inside(low - by), inside(high + by)), strict=True))
    joined = frames.join(detected, ["half_id", "frame_idx"]).withColumn("missed", missed)
    return joined.withColumns(bounds).select("half_id", "frame_idx", "boxes", *bounds)


def _known(bands: DataFrame, video: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The bands' bounds and scores as rows of numbers, and what was stored for them; a frame with nothing good enough in its band gets all that a search could reach."""
    scores = lambda found: found.select("half_id", "frames", "video", "scores")
    marks = lambda b: b.select("half_id", "frame_idx", "first", "beyond")
    near, narrow = _tile_scores(bands, video), F.expr("least < first or most > beyond")
    if bands.where(narrow).isEmpty():
        return marks(bands).unionByName(scores(near), allowMissingColumns=True), []
    near = stored(near)
    good = near.select("half_id", F.explode("good").alias("frame_idx")).distinct()
    poor = bands.where(narrow).join(good, ["half_id", "frame_idx"], "left_anti").withColumns({"first": F.col("least"), "beyond": F.col("most")})
    fine = bands.where(~narrow).unionByName(bands.where(narrow).join(good, ["half_id", "frame_idx"], "left_semi"))
    # a pair that both passes score has the same score in both
    return marks(fine).unionByName(marks(poor)).unionByName(scores(near).unionByName(scores(_tile_scores(poor, video))), allowMissingColumns=True), [near]


def align(detections: DataFrame, segmentation: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame_idx, all_frame_idx, mean_iou) of every detection frame from 0 to the half's last; both inputs have keys, frame_idx and bbox.

    Frame -1 with an overlap of -1 if no video frame could be tested. A task of the fold holds the boxes of a small half, WHOLE at most, or else
    numbers only, of one half: (detection frame, video frame, score), ten half steps per frame at first and BUDGET per video frame
    where no frame's band is poor; of a half of BUDGET frames or fewer all of them. Frames before 0 or without a number are left out; boxes with a null edge count as none; null keys are a half of their own.

    Rounds end when every half is through: most halves need one if frames are spread evenly, and each round settles a frame
    of each open half at least, since the first frame's band has its window in the middle and reaches as far as a search.
    """
    detected, video = (stored(boxes_by_frame(df, keys)) for df in (detections, segmentation))
    halves = checkpointed(detected.groupBy(*keys, "half_id").agg((F.max("frame_idx") + 1).alias("n"), F.sum(F.size("boxes")).alias("boxes")))
    sizes = video.groupBy("half_id").agg((F.max("frame_idx") + 1).alias("m"), F.sum(F.size("boxes")).alias("more"))
    start = halves.join(sizes, "half_id", "left").withColumns({"m": F.coalesce("m", F.lit(0)), "boxes": F.expr("boxes + coalesce(more, 0)")})
    states = checkpointed(start.selectExpr("half_id", "n", "m", "0L as at", "0L as low", "least(2 * m div n, m) as high", "0 as level", "boxes"))
    small, people, done = F.expr(f"n <= {BUDGET} and boxes <= {WHOLE}"), None, None
    while not states.isEmpty():
        rounds, folds, kept = _rounds(states), [], []
        if people is None:
            if not states.where(small).isEmpty():
                folds.append(_searched(states.where(small), detected, video))
            states = states.where(~small).drop("boxes")
            rounds = rounds.where(~small).drop("boxes")
        if not states.isEmpty():
            if people is None:
                ids = states.select("half_id")
                people, seen = stored(_with_gaps(detected.join(ids, "half_id", "left_semi"))), stored(video.join(ids, "half_id", "left_semi"))
            bands = stored(_bands(rounds, people))
            rows, kept = _known(bands, seen)
            rows, kept = rows.withColumnRenamed("half_id", "half"), [bands, *kept]
            folds.append(rounds.groupBy("half_id").cogroup(rows.groupBy("half")).applyInArrow(_fold, _FOUND))
        folded = checkpointed(reduce(DataFrame.unionByName, folds))
        settled = folded.select("half_id", "since", F.posexplode(F.arrays_zip("frames", "scores")).alias("i", "found"))
        done = settled if done is None else done.unionByName(settled)
        states = folded.where("at < n").drop("since", "frames", "scores")
        discard(*kept)
    discard(detected, video, *(() if people is None else (people, seen)))
    names = halves.select(*keys, "half_id")
    if done is None:
        return names.selectExpr(*keys, "0L as frame_idx", "0 as all_frame_idx", "0D as mean_iou").where("false")
    score = F.when(F.col("found.scores") == float("-inf"), ONE_EMPTY).otherwise(F.round("found.scores", 6))
    return done.join(names, "half_id").select(*keys, (F.col("since") + F.col("i")).alias("frame_idx"), F.col("found.frames").cast("int").alias("all_frame_idx"), score.alias("mean_iou"))
