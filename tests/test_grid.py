"""Cells of grids: connected parts against a flood fill, smoothing against weights on arrays."""

import numpy as np
import pytest

from pitchgrid.functions.pixels import labelled
from pitchgrid.operators import grid


def codes(mask, diagonal):
    """{(y, x): y * 2**31 + x of the first cell of its part}."""
    label = labelled(mask, diagonal)
    first = {}
    for y, x in np.argwhere(mask).tolist():
        first.setdefault(label[y, x], y * grid.ROW + x)
    return {(y, x): first[label[y, x]] for y, x in np.argwhere(mask).tolist()}


@pytest.mark.parametrize("diagonal", [False, True])
def test_parts_over_many_tiles(spark, monkeypatch, diagonal):
    rng = np.random.default_rng(6)
    masks = {("a", 1): rng.random((150, 200)) < 0.42, ("b", 1): np.zeros((140, 140), bool)}
    masks["b", 1][::4] = True  # a snake through all tiles
    masks["b", 1][2::8, -1] = masks["b", 1][6::8, 0] = True
    masks["b", 1][1::8, -1] = masks["b", 1][3::8, -1] = masks["b", 1][5::8, 0] = masks["b", 1][7::8, 0] = True
    rows = [(*k, y, x) for k, m in masks.items() for y, x in np.argwhere(m).tolist()]
    cells = spark.createDataFrame(rows + rows[:5], "match string, half int, y int, x int")
    got = {}
    for r in grid.connected_parts(cells, ["match", "half"], diagonal).collect():
        got.setdefault((r.match, r.half), {})[r.y, r.x] = r.part
    assert got == {k: codes(m, diagonal) for k, m in masks.items()}
    assert len(set(got["b", 1].values())) == 1
    assert grid.connected_parts(cells.limit(0), ["match", "half"]).count() == 0


@pytest.mark.parametrize("shape,sigma", [((9, 14), 1.0), ((3, 2), 1.5)])
def test_smoothing_mirrors_at_the_edges(spark, shape, sigma):
    a = np.random.default_rng(1).random(shape)
    rows = [("a", y, x, float(a[y, x]), *shape) for y in range(shape[0]) for x in range(shape[1])]
    cells = spark.createDataFrame(rows, "k string, y int, x int, value double, height int, width int")
    out = np.zeros(shape)
    for r in grid.gaussian_smooth(cells, ["k"], ["value"], sigma).collect():
        out[r.y, r.x] = r.value
    want = a
    for axis in (1, 0):
        weights = grid.gaussian_weights(sigma)
        reach = len(weights) // 2
        pad = np.pad(want, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        want = sum(w * np.take(pad, range(reach + k, reach + k + shape[axis]), axis=axis) for k, w in weights)
    assert np.allclose(out, want)
