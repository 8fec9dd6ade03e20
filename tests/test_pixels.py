"""Pixel leaves and the stages that use them."""

import numpy as np
import pytest

from pitchgrid.functions import pixels as P
from pitchgrid.plans import match

SQUARE = np.array([(2, 2), (7, 2), (7, 5), (2, 5)])


def test_fill_clips_and_paint_clamps():
    m = P.fill([SQUARE], (10, 10))
    assert m.sum() == 6 * 4 and m[2:6, 2:8].all()
    assert P.fill([SQUARE + 5], (10, 10)).sum() == 3 * 3
    assert P.paint(np.zeros((10, 10)), [SQUARE + [5, 5]], 1)[9, 9] == 1
    assert not P.fill([], (4, 4)).any()


def test_indices_keep_overlaps():
    rows, columns = P.indices([SQUARE, SQUARE], (10, 10))
    assert len(rows) == len(columns) == 48


@pytest.mark.parametrize("kind,size", [("rgb", 512), ("hsv", 512), ("lab", 512), ("hs", 64), ("ab", 64), ("oklab", 64)])
def test_histograms_sum_to_one(kind, size):
    rgb = np.random.default_rng(0).integers(0, 256, (9, 9, 3)).astype(np.uint8)
    h = P.colour_histogram(rgb, np.ones((9, 9), bool), kind)
    assert h.shape == (size,) and abs(h.sum() - 1) < 1e-6
    assert P.colour_histogram(rgb, np.zeros((9, 9), bool), kind).sum() == 0 and P.colour_histogram(rgb, np.ones((9, 9), bool), "cmyk") is None


def test_colour_spaces_of_known_colours():
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [255, 255, 255], [0, 0, 0]]], np.uint8)
    assert P.to_hsv(rgb)[0].tolist() == [[0, 255, 255], [60, 255, 255], [0, 0, 255], [0, 0, 0]]
    assert P.to_lab(rgb)[0, 2].tolist() == [255, 128, 128] and P.to_lab(rgb)[0, 3].tolist() == [0, 128, 128]
    assert abs(int(P.to_lab(rgb)[0, 0, 0]) - 136) <= 1
    assert abs(int(P.to_oklab(rgb)[0, 2, 0]) - 100) <= 1


def test_morphology_components_and_outlines():
    m = np.zeros((12, 12), bool)
    m[1:6, 1:6] = m[8:10, 8:11] = True
    assert P.erode(m, np.ones((3, 3), bool)).sum() == 9
    assert [p.sum() for p in P.components(m)] == [25, 6]
    assert P.opened(m, np.ones((3, 3), bool)).sum() == 25
    outline = P.contours(m)[0]
    x, y = outline[:, 0], outline[:, 1]
    assert abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2 == 25
    assert P.half(m, "upper").sum() == 25 and P.half(m, "lower").sum() == 6


def test_borders():
    flow = np.ones((4, 6, 2))
    assert P.with_borders(flow, 1, 0, 2, 1).shape == (5, 9, 2)
    m = P.without_borders(np.ones((10, 10)), (5, 8), 1, 0, 2, 0)
    assert m.sum() == 4 * 6  # a border of 0 blanks nothing


def test_parts_equal_a_flood_fill():
    rng = np.random.default_rng(4)
    for diagonal in (False, True):
        m = rng.random((30, 40)) < 0.45
        seen, want = np.zeros(m.shape, int), 0
        for y, x in np.argwhere(m):
            if not seen[y, x]:
                want += 1
                todo = [(y, x)]
                while todo:
                    b, a = todo.pop()
                    if 0 <= b < 30 and 0 <= a < 40 and m[b, a] and not seen[b, a]:
                        seen[b, a] = want
                        todo += [(b + q, a + p) for q in (-1, 0, 1) for p in (-1, 0, 1) if diagonal or 0 in (q, p)]
        assert (P.labelled(m, diagonal) == seen).all()


def test_a_hull_closes_bays_but_not_small_parts():
    m = np.zeros((40, 40), bool)
    m[5:30, 5:30] = True
    m[5:20, 15:18] = False  # a bay, open to the top
    m[25, 25] = False  # a hole
    m[35:38, 35:38] = True  # area 4 through pixel centres, less than (0.15 * 40) squared
    kept = P.large_hulls(m, 0.15)
    assert kept[5:30, 5:30].sum() == m[5:30, 5:30].sum() and not kept[35:38, 35:38].any()
    square = np.array([(x, y) for x in range(5, 9) for y in range(2, 6)])
    assert sorted(P.hull(square).tolist()) == [[5, 2], [5, 5], [8, 2], [8, 5]]
    thin = np.zeros((40, 40), bool)
    thin[0, :] = True  # 40 pixels, more than 36, but no area
    assert not P.large_hulls(thin, 0.15).any()


def picture():
    rgb = np.full((40, 60, 3), (40, 160, 50), np.uint8)
    rgb[:10] = (200, 30, 30)
    return rgb


def test_field_without_people_and_overlays():
    rgb = picture()
    logo = np.zeros((6, 10, 3), np.uint8)
    logo[:, :5], logo[:, 5:] = (40, 165, 55), (35, 155, 45)
    rgb[30:36, 4:14] = logo  # green like the field: only the overlay keeps it out
    person = ([30, 20, 36, 32], [np.array([(0, 0), (4, 0), (4, 10), (0, 10)])])
    overlay = ([4, 30, 14, 36], np.ones((6, 10), bool), logo.astype(float))
    field = P.field_mask(rgb, [person], [overlay], open_size=2)
    assert not field[:10].any() and not field[20:31, 30:35].any() and not field[30:36, 4:14].any() and field[12:].mean() > 0.8
    other = ([4, 30, 14, 36], np.ones((6, 10), bool), 255.0 - logo)
    assert P.field_mask(rgb, [person], [other], open_size=2)[31:35, 6:12].all()  # an overlay that the picture doesn't show


def test_ellipse_and_edge():
    assert P.ellipse(1).all() and P.ellipse(3).tolist() == [[False, True, False], [True] * 3, [False, True, False]]
    assert P.opened(np.ones((9, 9), bool), P.ellipse(8), beyond=True).all()


def test_person_vectors_and_velocities(spark):
    u, v = np.full((8, 8), 128, np.uint8), np.full((8, 8), 128, np.uint8)
    u[2:5, 2:5] = 192
    mask = [[(2, 2), (4, 2), (4, 4), (2, 4)]]
    schema = "match string, half int, frame_idx int, height int, width int, u binary, v binary, people array<struct<person_idx:int,mask:array<array<struct<x:int,y:int>>>>>"
    frames = spark.createDataFrame([("m", 1, 0, 8, 8, bytearray(u.tobytes()), bytearray(v.tobytes()), [(0, mask), (1, [])])], schema)
    vectors = match.person_vectors(frames)
    assert vectors.count() == 9
    r = match.velocities(vectors, vectors.limit(0)).collect()
    assert len(r) == 1 and abs(r[0].vx - (64 / 127.999) ** 2) < 1e-6 and r[0].vy == 0


def test_blobs_with_histograms(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rgb = np.full((60, 60, 3), 90, np.uint8)
    key = "match string, half int, frame_idx int"
    frames = spark.createDataFrame([("m", 1, 0, 60, 60, bytearray(rgb[..., ::-1].tobytes()))], f"{key}, height int, width int, data binary")
    d = spark.createDataFrame([("m", 1, 0, 0, (5.0, 5.0, 40.0, 50.0)), ("m", 1, 0, 1, (0.0, 0.0, 5.0, 5.0))], f"{key}, det_idx int, bbox {box}")
    mask = [[(0, 0), (30, 0), (30, 40), (0, 40)]]
    s = spark.createDataFrame([("m", 1, 0, 0, 0, 0.9, (5.0, 5.0, 41.0, 50.0), mask), ("m", 1, 0, 1, 0, 0.65, (0.0, 0.0, 5.0, 5.0), mask)], f"{key}, seg_idx int, class_id int, score double, bbox {box}, mask array<array<struct<x:int,y:int>>>")
    rows = match.with_histograms(match.blobs(d, s), frames).collect()
    assert [r.det_idx for r in rows] == [0] and abs(sum(rows[0].hist) - 1) < 1e-6


def test_keepers(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rows = [("m", 1, 0, 0, 1.0, 16.0), ("m", 1, 0, 1, 63.0, 16.0), ("m", 2, 0, 0, 1.0, 16.0), ("m", 2, 0, 1, 2.0, 16.0)]
    people = spark.createDataFrame([(*r[:4], (0.0, 0.0, 1.0, 1.0), *r[4:], 1.0) for r in rows], f"match string, half int, frame_idx int, det_idx int, bbox {box}, radar_x double, radar_y double, goal_dist double")
    got = sorted((r.half, r.det_idx, r.category) for r in match.keepers_of_both_sides(people).collect())
    assert got == [(1, 1, 4)]  # half 2: not isolated
