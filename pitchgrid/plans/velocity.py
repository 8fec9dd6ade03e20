"""Velocities of a match's halves from its pictures: overlays, the field, and each person's motion relative to it.

Tables hold paths; the task that works on a frame opens its three pictures (``sources.pictures``). One row of sums per frame
leaves it, so neither pictures nor their pixels are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.functions import pixels
from pitchgrid.functions.pictures import decoded
from pitchgrid.functions.vectors import orientation
from pitchgrid.operators.grid import connected_parts, gaussian_smooth
from pitchgrid.operators.motion import flow_geometry
from pitchgrid.operators.ranking import sampling_index
from pitchgrid.plans.config import VelocityConfig
from pitchgrid.schema import POLYGONS
from pitchgrid.sources.pictures import HALF, frame_pictures, opened, with_flow
from pitchgrid.sources.shared import checkpointed

FRAME = [*HALF, "frame_idx"]
BORDERS = ["top", "bottom", "left", "right"]
SIGMA, KMEANS_ROUNDS, MAX_ENERGY = 3.0, 100, 0.01
#: Overlays are sent to all tasks if their pixels are counted to be no more than this, and joined by half beyond that.
MAX_BROADCAST_PIXELS = 16_000_000
#: Sums of pictures that a task holds at a time.
HALVES_AT_ONCE = 8
MOTION = f"match string, half int, frame_idx int, field {POLYGONS}, ground array<double>, people array<struct<person_idx:int,own:array<double>>>"
SUMS = "match string, half int, y int, n bigint, width int, height int, sums array<bigint>"


def _flow(row: dict) -> np.ndarray:
    return pixels.dequantized(decoded(opened(row["u"])), decoded(opened(row["v"])))


def picture_shapes(listing: DataFrame) -> DataFrame:
    """(match, half, height, width, top, bottom, left, right): the size of each half's first frame, and its flow's borders.

    Heights without known borders have none.
    """
    first = frame_pictures(listing).groupBy(*HALF).agg(F.min_by("rgb", "frame_idx").alias("rgb"))

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            sizes = [decoded(opened(r["rgb"])).shape for r in rows]
            names = {c: [r[c] for r in rows] for c in HALF}
            yield pa.RecordBatch.from_pydict(names | {"height": [s[0] for s in sizes], "width": [s[1] for s in sizes]}, pa.schema([("match", pa.string()), *[(c, pa.int32()) for c in ("half", "height", "width")]]))

    sizes = first.mapInArrow(shape, "match string, half int, height int, width int")
    known = F.broadcast(flow_geometry(listing.sparkSession).select("height", *BORDERS))  # one row a known height
    return sizes.join(known, "height", "left").select(*HALF, "height", "width", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in BORDERS])


def sampled_frames(sizes: DataFrame, samples: int) -> DataFrame:
    """(match, half, k, frame_idx): an even grid over all frames of each half of sizes(match, half, n_frames), both ends included."""
    k = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k")
    return sizes.select(*HALF, "n_frames", k).select(*HALF, "k", sampling_index(F.col("k"), F.col("n_frames"), samples).cast("int").alias("frame_idx"))


def _added(rows: DataFrame, arrays: Iterator, keys: list[str], ddl: str) -> DataFrame:
    """rows(keys, paths) -> partial sums of a task's pictures, by keys; arrays(row) gives (key values, picture) pairs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        kinds = [pa.string(), *[pa.int32()] * (len(keys) - 1), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        names = [*keys, "y", "n", "width", "height", "sums"]

        def flushed() -> Iterator[pa.RecordBatch]:
            for key, (n, total) in sums.items():
                height, width = total.shape[:2]
                rows = [[*key, y, n, width, height, total[y].ravel().tolist()] for y in range(height)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            sums.clear()

        for batch in batches:
            for row in batch.to_pylist():
                for key, picture in arrays(row):
                    held = sums.setdefault(key, [0, np.zeros(picture.shape, np.int64)])
                    held[0] += 1
                    held[1] += picture
                if len(sums) >= HALVES_AT_ONCE:
                    yield from flushed()
        yield from flushed()

    parts = rows.mapInArrow(add, ddl)
    each = parts.select(*keys, "y", "n", "width", "height", F.posexplode("sums").alias("pos", "s"))
    return each.groupBy(*keys, "y", "width", "height", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def mean_flow(frames: DataFrame) -> DataFrame:
    """(match, half, y, x, u, v, height, width): the mean absolute flow at every pixel over frames(match, half, u, v), paths.

    Bytes less 128 are added as integers, so the result doesn't depend on the order of the frames.
    """

    def sizes(row: dict) -> list:
        uv = [np.abs(decoded(opened(row[c])).astype(np.int64) - 128) for c in "uv"]
        return [((row["match"], row["half"]), np.stack(uv, axis=-1))]

    cells = _added(frames.select(*HALF, "u", "v"), sizes, HALF, SUMS)
    mean = F.col("s") / (F.col("n") * F.lit(127.999))
    pixel = cells.groupBy(*HALF, "height", "width", "y", F.expr("pos div 2").alias("x"))
    return pixel.agg(*[F.max(F.when(F.col("pos") % 2 == k, mean)).alias(c) for k, c in enumerate("uv")])


def still_cells(flow: DataFrame, clusters: int) -> DataFrame:
    """(match, half, y, x) of the pixels whose cluster of mean flow hardly moves. One half's picture is one group, of a picture's fixed size."""

    def still(grid: pd.DataFrame) -> pd.DataFrame:
        grid = grid.sort_values(["y", "x"])
        label, centres = pixels.lloyd(grid[["u", "v"]].to_numpy(), clusters, KMEANS_ROUNDS)
        keep = np.isin(label, np.flatnonzero((centres**2).sum(axis=1) / 2 < MAX_ENERGY))
        return grid.loc[keep, [*HALF, "y", "x"]]

    return flow.groupBy(*HALF).applyInPandas(still, "match string, half int, y int, x int")


def regions(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """(match, half, region_idx, box, mask): the parts of cells(match, half, y, x, height, width) as boxes of the frame's picture.

    cells are pixels of the flow without its borders, height and width its size. A mask has one byte a pixel of the box, whose
    lower and right edges are outside; regions count by their first pixel.
    """
    parts = connected_parts(cells, HALF)
    size = cells.select(*HALF, F.col("height").alias("fh"), F.col("width").alias("fw")).distinct()
    whole = parts.join(size, HALF).join(shapes, HALF)
    schema = "match string, half int, part bigint, box array<int>, mask binary"

    def region(part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[0]
        y0, x0 = int(part["y"].min()) + one["top"], int(part["x"].min()) + one["left"]
        cut = np.zeros((int(part["y"].max()) + one["top"] - y0 + 1, int(part["x"].max()) + one["left"] - x0 + 1), bool)
        cut[part["y"] + one["top"] - y0, part["x"] + one["left"] - x0] = True
        # the pixels of the picture whose nearest flow pixel is in the part
        at = [((np.arange(one[c]) + 0.5) * n / one[c]).astype(int) for c, n in (("height", one["fh"] + one["top"] + one["bottom"]), ("width", one["fw"] + one["left"] + one["right"]))]
        rows, columns = (np.flatnonzero((a >= low) & (a < low + n)) for a, low, n in zip(at, (y0, x0), cut.shape, strict=True))
        out = part.head(1)[[*HALF, "part"]]
        if not len(rows) or not len(columns):
            return out.head(0).assign(box=None, mask=None)
        mask = cut[np.ix_(at[0][rows] - y0, at[1][columns] - x0)]
        box = [int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1]
        return out.assign(box=[box], mask=[mask.astype(np.uint8).tobytes()])

    # one part is a group: a picture's pixels at most
    found = whole.groupBy(*HALF, "part").applyInPandas(region, schema)
    # a half's parts are ranked by a count of those before them in its own short list
    listed = found.groupBy(*HALF).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    place = (F.array_position("parts", F.col("part")) - 1).cast("int")
    return found.join(listed, HALF).select(*HALF, place.alias("region_idx"), "box", "mask")


def region_patches(found: DataFrame, frames: DataFrame) -> DataFrame:
    """found regions with patch: the mean of each region's box over frames(match, half, rgb), outside the mask 0, as 8-byte floats."""
    boxes = found.groupBy(*HALF).agg(F.collect_list(F.struct("region_idx", "box")).alias("boxes"))

    def cuts(row: dict) -> Iterator:
        rgb = decoded(opened(row["rgb"])).astype(np.int64)
        for r in row["boxes"]:
            yield (row["match"], row["half"], r["region_idx"]), pixels.patch(rgb, r["box"], copy=False)

    keys = [*HALF, "region_idx"]
    sums = _added(frames.select(*HALF, "rgb").join(boxes, HALF), cuts, keys, SUMS.replace("half int,", "half int, region_idx int,"))
    mean = F.least(F.col("s") / F.col("n"), F.lit(255.0))
    ordered = F.array_sort(F.collect_list(F.struct("y", "pos", mean.alias("m"))))
    means = sums.groupBy(*keys).agg(F.transform(ordered, lambda x: x["m"]).alias("mean"))

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            patches = [(np.array(r["mean"]).reshape(-1, 3) * np.frombuffer(r["mask"], np.uint8)[:, None]).tobytes() for r in rows]
            kept = batch.select([*keys, "box", "mask"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(patches, pa.binary())], [*kept.schema.names, "patch"])

    return found.join(means, keys).select(*keys, "box", "mask", "mean").mapInArrow(masked, "match string, half int, region_idx int, box array<int>, mask binary, patch binary")


def overlays(listing: DataFrame, counts: DataFrame, sizes: DataFrame, shapes: DataFrame, options: VelocityConfig = VelocityConfig(), repaired: DataFrame | None = None) -> DataFrame:
    """(match, half, region_idx, box, mask, patch) of the regions of each half's picture that don't move over sampled frames."""
    sample = checkpointed(with_flow(sampled_frames(sizes, options.sampling_frames), listing, counts, sizes, repaired))
    smooth = checkpointed(gaussian_smooth(mean_flow(sample), HALF, ["u", "v"], SIGMA))
    cells = still_cells(smooth, options.region_clusters).join(smooth.select(*HALF, "height", "width").distinct(), HALF)
    return region_patches(checkpointed(regions(cells, shapes)), sample)


def frame_motion(frames: DataFrame, options: VelocityConfig = VelocityConfig()) -> DataFrame:
    """One row a frame: the field's outlines in the picture, and sums of the flow on the field and on each person.

    frames has match, half, frame_idx, rgb, u, v (paths), the flow's borders, people (person_idx, bbox, mask) and overlays
    (box, mask, patch) or null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                rgb, border = decoded(opened(row["rgb"])), [row[c] for c in BORDERS]
                flow = pixels.with_borders(_flow(row), *border)
                people = [(p["person_idx"], [p["bbox"][c] for c in ("x1", "y1", "x2", "y2")], [np.array([(q["x"], q["y"]) for q in poly]) for poly in p["mask"] or []]) for p in row["people"]]
                hidden = []
                for o in row["overlays"] or []:
                    shape = (o["box"][3] - o["box"][1], o["box"][2] - o["box"][0])
                    hidden.append((o["box"], np.frombuffer(o["mask"], np.uint8).reshape(shape).astype(bool), np.frombuffer(o["patch"], float).reshape(*shape, 3)))
                field = pixels.field_mask(
                    rgb, [p[1:] for p in people], hidden, options.colour_clusters, options.max_iter, options.min_similarity,
                    open_size=options.opening_size, min_share=options.min_area_share,
                )
                scale, own = np.array(flow.shape[1::-1]) / rgb.shape[1::-1], []
                for idx, box, polygons in people:
                    at, scaled = pixels.scaled_person(box, polygons, scale)
                    cut = pixels.patch(flow, at, copy=False)
                    # a person without outlines is all of its box
                    own.append({"person_idx": idx, "own": pixels.moments(cut[pixels.indices(scaled, cut.shape[:2])] if scaled else cut)})
                lines = [[{"x": int(x), "y": int(y)} for x, y in line] for line in pixels.contours(field)]
                ground = pixels.moments(flow[pixels.without_borders(field, flow.shape[:2], *border)])
                key = {c: row[c] for c in FRAME}
                yield pa.RecordBatch.from_pylist([key | {"field": lines, "ground": ground, "people": own}], MOTION_SCHEMA)

    return frames.select(*FRAME, "rgb", "u", "v", *BORDERS, "people", "overlays").mapInArrow(run, MOTION)


_SUMS = pa.list_(pa.float64())
_POLYGONS = pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))
MOTION_SCHEMA = pa.schema([("match", pa.string()), ("half", pa.int32()), ("frame_idx", pa.int32()), ("field", _POLYGONS), ("ground", _SUMS), ("people", pa.list_(pa.struct([("person_idx", pa.int32()), ("own", _SUMS)])))])


def half_frames(people: DataFrame, listing: DataFrame, counts: DataFrame, sizes: DataFrame, shapes: DataFrame, hidden: DataFrame | None = None, repaired: DataFrame | None = None) -> DataFrame:
    """What frame_motion takes, for each frame of people(match, half, frame_idx, person_idx, bbox, mask); frames without people are left out."""
    each = people.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("person_idx", "bbox", "mask"))).alias("people"))
    rows = with_flow(each, listing, counts, sizes, repaired).join(shapes.select(*HALF, *BORDERS), HALF)
    kind = "array<struct<box:array<int>,mask:binary,patch:binary>>"
    if hidden is None:
        return rows.withColumn("overlays", F.lit(None).cast(kind))
    many = hidden.agg(F.sum(F.length("mask"))).first()[0] or 0
    grouped = hidden.groupBy(*HALF).agg(F.collect_list(F.struct("box", "mask", "patch")).alias("overlays"))
    return rows.join(F.broadcast(grouped) if many <= MAX_BROADCAST_PIXELS else grouped, HALF, "left")


def motion_vector(sums: Column) -> tuple[Column, Column]:
    """The dominant motion of sums as ``pixels.moments`` orders them."""
    return orientation(*[F.get(sums, F.lit(k)) for k in range(8)])


def relative_velocities(motion: DataFrame) -> DataFrame:
    """(match, half, frame_idx, person_idx, vx, vy, field_vx, field_vy) of every person; a frame without visible field counts as still."""
    gx, gy = motion_vector(F.col("ground"))
    each = motion.select(*FRAME, gx.alias("field_vx"), gy.alias("field_vy"), F.explode("people").alias("p"))
    px, py = motion_vector(F.col("p.own"))
    return each.select(*FRAME, "p.person_idx", (px - F.col("field_vx")).alias("vx"), (py - F.col("field_vy")).alias("vy"), "field_vx", "field_vy")


def half_velocities(
    people: DataFrame, listing: DataFrame, counts: DataFrame, sizes: DataFrame, options: VelocityConfig = VelocityConfig(),
    repaired: DataFrame | None = None, with_overlays: bool = True,
) -> DataFrame:
    """Velocities of all people of all halves, from pictures to rows, overlays included."""
    shapes = checkpointed(picture_shapes(listing))
    hidden = checkpointed(overlays(listing, counts, sizes, shapes, options, repaired)) if with_overlays else None
    return relative_velocities(frame_motion(half_frames(people, listing, counts, sizes, shapes, hidden, repaired), options))
