"""Column expressions over boxes and pitch calibration. Boxes are structs x1, y1, x2, y2 with inclusive edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PITCH_LENGTH, PITCH_WIDTH = 105.0, 68.0
RADAR_WIDTH, RADAR_HEIGHT = 64.0, 32.0
GOALS = ((0.0, 16.0), (64.0, 16.0))


def box(x1, y1, x2, y2) -> Column:
    """A box struct of four columns."""
    parts = dict(x1=x1, y1=y1, x2=x2, y2=y2)
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).cast("double").alias(k) for k, v in parts.items()])


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"] + 1) * (b["y2"] - b["y1"] + 1)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; null where the union is empty."""
    wide = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + 1)
    high = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + 1)
    return F.try_divide(wide * high, area(a) + area(b) - wide * high)


def foot_point(b: Column) -> tuple[Column, Column]:
    """Bottom centre of a box, x truncated to an integer."""
    return ((b["x1"] + b["x2"]) / 2).cast("int").cast("double"), b["y2"]


def unproject(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Pitch metres of an image point under the inverse of homography h (nine numbers, by row).

    The adjugate stands for the inverse: its common factor, the determinant, cancels in the projection.
    """
    e = [F.get(h, F.lit(i)) for i in range(9)]
    u = (e[4] * e[8] - e[5] * e[7]) * x + (e[2] * e[7] - e[1] * e[8]) * y + (e[1] * e[5] - e[2] * e[4])
    v = (e[5] * e[6] - e[3] * e[8]) * x + (e[0] * e[8] - e[2] * e[6]) * y + (e[2] * e[3] - e[0] * e[5])
    w = (e[3] * e[7] - e[4] * e[6]) * x + (e[1] * e[6] - e[0] * e[7]) * y + (e[0] * e[4] - e[1] * e[3])
    return F.try_divide(u, w), F.try_divide(v, w)


def radar(x: Column, y: Column) -> tuple[Column, Column]:
    """Radar coordinates of pitch metres."""
    return RADAR_WIDTH * (0.95 * x / PITCH_LENGTH + 0.525), RADAR_HEIGHT * (0.95 * y / PITCH_WIDTH + 0.525)


def goal_distance(rx: Column, ry: Column) -> Column:
    """Distance on the radar to the nearer goal."""
    return F.least(*[F.sqrt((rx - gx) * (rx - gx) + (ry - gy) * (ry - gy)) for gx, gy in GOALS])


def scaled_x(x: Column, sar: Column) -> Column:
    """x under a sampling aspect ratio, which applies only if over 1."""
    return F.when(sar > 1, x * sar).otherwise(x)


def truncated_box(b: Column, sx: Column, sy: Column) -> Column:
    """A rescaled box, truncated to integers."""
    return F.struct(*[(b[c] * (sx if c[0] == "x" else sy)).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])


def scaled_polygons(mask: Column, old: Column, new: Column) -> Column:
    """Polygons (arrays of x, y structs) rescaled by the sizes of their box before and after."""
    sx = F.try_divide(new["x2"] - new["x1"], old["x2"] - old["x1"])
    sy = F.try_divide(new["y2"] - new["y1"], old["y2"] - old["y1"])
    return F.transform(mask, lambda poly: F.transform(poly, lambda p: F.struct((p["x"] * sx).cast("int").alias("x"), (p["y"] * sy).cast("int").alias("y"))))


def corners(left: Column, top: Column, width: Column, height: Column) -> Column:
    """A box struct from its left, top, width and height."""
    return box(left, top, left + width, top + height)
