"""From picture files to velocities, overlays included."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchgrid.functions import pictures as C
from pitchgrid.functions import pixels as P
from pitchgrid.operators.grid import gaussian_weights
from pitchgrid.plans import velocity as V
from pitchgrid.plans.config import VelocityConfig
from pitchgrid.sources import pictures as S

OPTIONS = VelocityConfig(sampling_frames=6, region_clusters=3, opening_size=2)
SIZE, N = 80, 6
LOGO = (slice(0, 30), slice(0, 40))


def test_png_of_all_filters():
    rng = np.random.default_rng(0)
    for image in (rng.integers(0, 256, (7, 9)).astype(np.uint8), rng.integers(0, 256, (7, 9, 3)).astype(np.uint8)):
        assert (C.decoded(C.png(image)) == image).all()
        step = 1 if image.ndim == 2 else 3
        rows, before, lines = image.reshape(7, -1).astype(int), np.zeros(9 * step, int), []
        for y, row in enumerate(rows):
            left, corner = np.concatenate(([0] * step, row[:-step])), np.concatenate(([0] * step, before[:-step]))
            near = np.stack([left, before, corner])
            paeth = np.take_along_axis(near, np.abs(left + before - corner - near).argmin(axis=0)[None], 0)[0]
            guess = [0 * row, left, before, (left + before) // 2, paeth][y % 5]
            lines.append(bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes())
            before = row
        head = struct.pack(">IIBBBBB", 9, 7, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"crc!"
        assert (C.decoded(C.MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines)))) == image).all()
    if C.Image is None:
        with pytest.raises(ValueError, match="Pillow"):
            C.decoded(b"\xff\xd8\xff")


def half_of(seed):
    """Frames with a green field under a still logo, and flow that moves everywhere else."""
    rng = np.random.default_rng(seed)
    frames, flows = [], []
    for _ in range(N):
        rgb = np.full((SIZE, SIZE, 3), (40, 150, 50), np.uint8)
        rgb[60:] = (200, 30, 30)
        rgb[LOGO] = (45, 155, 55)
        frames.append(rgb)
        uv = rng.integers(200, 250, (2, SIZE, SIZE)).astype(np.uint8)
        uv[:, LOGO[0], LOGO[1]] = 128
        flows.append(uv)
    return frames, flows


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("a match"))
    rows = []
    for half in (1, 2):
        frames, flows = half_of(half)
        for k in range(N):
            rows += [("m 1", half, "frames", k, bytearray(C.png(frames[k])))]
            rows += [("m 1", half, s, k, bytearray(C.png(flows[k][i]))) for i, s in enumerate("uv")]
    written = S.write_pictures(spark.createDataFrame(rows, "match string, half int, series string, number int, data binary"), root)
    assert written == 2 * 3 * N
    listing = S.list_pictures(spark, root)
    counts = spark.createDataFrame([("m 1", 1, N), ("m 1", 2, N)], "match_path string, half int, n_flow int")
    people = spark.createDataFrame(
        [("m 1", h, k, 0, (50.0, 20.0, 60.0, 40.0), [[(0, 0), (9, 0), (9, 19), (0, 19)]]) for h in (1, 2) for k in range(N) if k != 3],
        "match string, half int, frame_idx int, person_idx int, bbox struct<x1:double,y1:double,x2:double,y2:double>, mask array<array<struct<x:int,y:int>>>",
    )
    return listing, counts, S.frame_counts(listing), people


def test_listing_and_pairs(spark, halves):
    listing, counts, sizes, _ = halves
    assert listing.count() == 6 * N and {(r.match, r.half, r.n_frames) for r in sizes.collect()} == {("m 1", 1, N), ("m 1", 2, N)}
    frames = listing.where("series = 'frames'").select("match", "half", F.col("number").alias("frame_idx"))
    rows = S.with_flow(frames, listing, counts, sizes).collect()
    assert len(rows) == 2 * N
    assert all(r.rgb.endswith(f"frames/{r.frame_idx + 1:05}.png") and r.u.endswith(f"u/{r.frame_idx:06}.png") and r.v.endswith(f"v/{r.frame_idx:06}.png") for r in rows)
    fixed = spark.createDataFrame([("m 1", 1, 0, 9, 12)], "match string, half int, frame_idx int, all_frame_idx int, n_all int")
    moved = {(r.half, r.frame_idx): r.u for r in S.with_flow(frames, listing, counts, sizes, fixed).collect()}
    assert moved[1, 0].endswith("u/000004.png") and moved[2, 0].endswith("u/000000.png")  # int(9 * 5 / 11)


def test_overlays_are_found_with_their_mean_patch(halves):
    listing, counts, sizes, _ = halves
    shapes = V.picture_shapes(listing)
    rows = sorted(V.overlays(listing, counts, sizes, shapes, OPTIONS).collect(), key=lambda r: (r.half, r.region_idx))
    assert [(r.half, r.region_idx) for r in rows] == [(1, 0), (2, 0)]
    for r in rows:
        x1, y1, x2, y2 = r.box
        mask = np.frombuffer(r.mask, np.uint8).reshape(y2 - y1, x2 - x1).astype(bool)
        patch = np.frombuffer(r.patch, float).reshape(y2 - y1, x2 - x1, 3)
        mean = np.abs(np.stack(half_of(r.half)[1]).astype(int) - 128).sum(axis=0) / (N * 127.999)
        for axis in (1, 2):  # smoothed as a whole array
            pad = np.pad(mean, [(12, 12) if k == axis else (0, 0) for k in range(3)], mode="symmetric")
            mean = sum(w * np.take(pad, range(12 + k, 12 + k + SIZE), axis=axis) for k, w in V_WEIGHTS)
        label, centres = P.lloyd(np.moveaxis(mean, 0, -1).reshape(-1, 2), 3, 100)
        want = np.isin(label, np.flatnonzero((centres**2).sum(axis=1) / 2 < V.MAX_ENERGY)).reshape(SIZE, SIZE)
        got = np.zeros((SIZE, SIZE), bool)
        got[y1:y2, x1:x2] = mask
        assert (got == want).all() and want[:20, :30].all() and not want[45:].any()
        assert np.allclose(patch, half_of(r.half)[0][0][y1:y2, x1:x2] * mask[..., None])


V_WEIGHTS = gaussian_weights(V.SIGMA)


def test_velocities_with_overlays(halves):
    listing, counts, sizes, people = halves
    shapes = V.picture_shapes(listing)
    hidden = V.overlays(listing, counts, sizes, shapes, OPTIONS)
    motion = V.frame_motion(V.half_frames(people, listing, counts, sizes, shapes, hidden), OPTIONS).collect()
    plain = V.frame_motion(V.half_frames(people, listing, counts, sizes, shapes), OPTIONS).collect()
    assert len(motion) == len(plain) == 2 * (N - 1)  # a frame without people is left out
    assert all(r.ground[3] < p.ground[3] for r, p in zip(sorted(motion), sorted(plain), strict=True))  # the logo is green, but no field
    r = motion[0]
    flow = P.dequantized(*half_of(r.half)[1][r.frame_idx])
    assert np.allclose(r.people[0].own, P.moments(flow[20:40, 50:60]))
    got = V.half_velocities(people, listing, counts, sizes, OPTIONS).collect()
    assert len(got) == 2 * (N - 1) and all(abs(r.vx) < 0.2 and r.field_vx > 0.3 for r in got)


def test_no_picture_crosses_an_exchange(halves):
    listing, counts, sizes, people = halves
    shapes = V.picture_shapes(listing)
    df = V.frame_motion(V.half_frames(people, listing, counts, sizes, shapes))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and plan.count("MapInArrow") == 2  # the shapes and the frames
    assert "Exchange" not in plan.split("MapInArrow")[0]


def test_one_person_outside_and_unknown_heights(spark, halves):
    listing, counts, sizes, people = halves
    outside = people.limit(1).withColumn("bbox", F.expr("named_struct('x1', 500D, 'y1', 500D, 'x2', 510D, 'y2', 510D)"))
    rows = V.half_velocities(outside, listing, counts, sizes, OPTIONS, with_overlays=False).collect()
    assert len(rows) == 1 and rows[0].vx == -rows[0].field_vx
    assert V.half_velocities(people.limit(0), listing, counts, sizes, OPTIONS, with_overlays=False).count() == 0
