"""Column expressions over numeric arrays and small sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def bhattacharyya(u: Column, v: Column) -> Column:
    """Distance of two histograms; null if either is empty of mass."""
    shared = total(F.zip_with(u, v, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))))
    alike = F.try_divide(shared, F.sqrt(total(u) * total(v)))
    return F.when(alike.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 1 - alike)))


def squared_error(u: Column, v: Column, scale: float = 1.0) -> Column:
    """Mean squared difference divided by scale."""
    parts = total(F.zip_with(u, v, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return F.try_divide(parts, F.size(u) * F.lit(scale))


def argmax(a: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """Heron's formula; null for sides that form no triangle."""
    s = (a + b + c) / 2
    inside = s * (s - a) * (s - b) * (s - c)
    return F.when(inside >= 0, F.sqrt(inside))


def orientation(suu: Column, svv: Column, suv: Column, n: Column, u_up: Column, u_down: Column, v_up: Column, v_down: Column) -> tuple[Column, Column]:
    """Dominant motion from second moments: mean squared length along the main axis, each sign by majority.

    The axis of a moment matrix (a, b; b, d) is at half the angle of (a - d, 2b). Counts up are values in [0, 1], counts
    down in [-1, 0); ties go down.
    """
    angle = 0.5 * F.atan2(2 * suv, suu - svv)
    size = F.coalesce(F.try_divide(suu + svv, n), F.lit(0.0))
    sign = lambda up, down: F.when(up > down, 1.0).otherwise(-1.0)
    return size * sign(u_up, u_down) * F.abs(F.cos(angle)), size * sign(v_up, v_down) * F.abs(F.sin(angle))
