"""Optical-flow geometry and velocities relative to the field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.operators.aggregation import dominant_orientation

# Frame height; frame size and borders of the undistorted picture (rows, columns); flow size
FLOW_CONSTANTS = [
    (480, 390, 693, 3.0, 26.5, 256, 426),
    (576, 468, 832, 10.0, 0.0, 256, 475),
    (720, 585, 1040, 8.0, 4.5, 256, 455),
    (768, 624, 1109, 24.0, 10.5, 256, 483),
    (1080, 877, 1560, 22.5, 12.0, 256, 472),
]


def flow_geometry(spark: SparkSession) -> DataFrame:
    """Flow size, borders (larger half first) and full size for each known frame height."""
    rows = spark.createDataFrame(FLOW_CONSTANTS, "height int, rh int, rw int, bh double, bw double, flow_height int, flow_width int")
    y = F.col("bh") * F.col("flow_height") / (F.col("rh") - 2 * F.col("bh")).cast("int")
    x = F.col("bw") * F.col("flow_width") / (F.col("rw") - 2 * F.col("bw")).cast("int")
    sides = {"top": F.ceil(y), "bottom": F.floor(y), "left": F.ceil(x), "right": F.floor(x)}
    out = rows.select("height", "flow_height", "flow_width", *[c.cast("int").alias(n) for n, c in sides.items()])
    return out.withColumns({"full_height": F.col("flow_height") + F.col("top") + F.col("bottom"), "full_width": F.col("flow_width") + F.col("left") + F.col("right")})


def relative_velocity(people: DataFrame, field: DataFrame, frame: list[str], person: str) -> DataFrame:
    """(frame, person, vx, vy): each person's dominant motion less the field's; a frame without field flow counts as still.

    people and field are rows of flow vectors u, v.
    """
    own = dominant_orientation(people, [*frame, person])
    ground = dominant_orientation(field, frame).withColumnsRenamed({"vx": "fx", "vy": "fy"})
    diff = lambda a, b: (F.col(a) - F.coalesce(F.col(b), F.lit(0.0))).alias(a)
    return own.join(ground, frame, "left").select(*frame, person, diff("vx", "fx"), diff("vy", "fy"))
