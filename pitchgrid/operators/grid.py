"""Pixel grids as tables of cells: smoothing and connected parts of grids of any size."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.functions.pixels import labelled
from pitchgrid.sources.shared import checkpointed

TILE = 64
#: A cell's number: its row times this, plus its column.
ROW = 1 << 31


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) of a sampled Gaussian cut at so many standard deviations; weights sum to 1."""
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [(k - reach, w / sum(raw)) for k, w in enumerate(raw)]


def _mirrored(at: Column, n: Column) -> Column:
    """at inside 0..n-1, mirrored at the edges as often as needed, edge cells repeated."""
    turn = F.pmod(at, 2 * n)
    return F.least(turn, 2 * n - 1 - turn)


def gaussian_smooth(cells: DataFrame, by: list[str], values: list[str], sigma: float) -> DataFrame:
    """cells(by, y, x, values, height, width) smoothed along x, then y.

    Each cell hands its weighted values to its neighbours, whose sums combine in the map tasks. Grids must be complete.
    """
    for axis, size in (("x", "width"), ("y", "height")):
        offers = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in gaussian_weights(sigma)])
        other = "y" if axis == "x" else "x"
        handed = cells.select(*by, "height", "width", other, F.col(axis).alias("__at"), *values, F.explode(offers).alias("o"))
        # a cell receives what lies an offset beyond it, so what falls beyond the edge is handed out once per mirror image
        reach = F.col("__at") + F.col("o.k")
        inside = handed.withColumn(axis, reach).where((reach >= 0) & (reach < F.col(size)))
        mirrored = _folded(handed, axis, size, sigma)
        both = inside.select(*by, "height", "width", "y", "x", "o.w", *values).unionByName(mirrored.select(*by, "height", "width", "y", "x", "w", *values))
        cells = both.groupBy(*by, "height", "width", "y", "x").agg(*[F.sum(F.col(v) * F.col("w")).alias(v) for v in values])
    return cells


def _folded(handed: DataFrame, axis: str, size: str, sigma: float) -> DataFrame:
    """What cells near an edge hand over it: cell c stands at every place beyond the edge that mirrors to it."""
    reach = len(gaussian_weights(sigma)) // 2
    first = handed.where("o.k = 0").drop("o")
    beyond = F.explode(F.filter(F.sequence(F.lit(-reach), F.col(size) + reach - 1), lambda p: (p < 0) | (p >= F.col(size))))
    near = first.where((F.col("__at") < reach) | (F.col("__at") >= F.col(size) - reach) | (F.col(size) <= reach))
    placed = near.withColumn("__p", beyond).where(_mirrored(F.col("__p"), F.col(size)) == F.col("__at"))
    offers = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in gaussian_weights(sigma)])
    given = placed.withColumn("__o", F.explode(offers)).withColumn(axis, F.col("__p") + F.col("__o.k"))
    return given.where((F.col(axis) >= 0) & (F.col(axis) < F.col(size))).withColumn("w", F.col("__o.w"))


def _tile_labels(by: list[str], diagonal: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def label(tile: pd.DataFrame) -> pd.DataFrame:
        y, x = tile["y"].to_numpy(), tile["x"].to_numpy()
        mask = np.zeros((TILE, TILE), bool)
        mask[y % TILE, x % TILE] = True
        part = labelled(mask, diagonal)[y % TILE, x % TILE]
        code = y * ROW + x
        least = np.full(part.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, part, code)
        return tile[[*by, "y", "x"]].assign(c=least[part])

    return label


def _across_tiles(cells: DataFrame, by: list[str], diagonal: bool) -> DataFrame:
    """(by, u, v) of the tiles' parts that touch over a border, u > v."""
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    ahead = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps])).alias("n")
    tile = lambda y, x: F.struct(F.expr(f"{y} div {TILE}"), F.expr(f"{x} div {TILE}"))
    left = cells.select(*by, "y", "x", F.col("c").alias("a"), ahead).where(tile("y", "x") != tile("n.y", "n.x"))
    left = left.select(*by, F.col("n.y").alias("y"), F.col("n.x").alias("x"), "a")
    edge = (F.col("y") % TILE).isin(0, TILE - 1) | (F.col("x") % TILE).isin(0, TILE - 1)
    met = left.join(cells.where(edge).select(*by, "y", "x", F.col("c").alias("b")), [*by, "y", "x"]).where("a <> b")
    return met.select(*by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _merged(edges: DataFrame, by: list[str]) -> DataFrame | None:
    """(by, c, part): what each part that isn't its group's first becomes. Every round all parts hook on to their smallest neighbour, and chains are cut short."""
    found = None
    edges = checkpointed(edges)
    while not edges.isEmpty():
        hook = checkpointed(edges.groupBy(*by, F.col("u").alias("c")).agg(F.min("v").alias("part")))
        while True:
            further = hook.select(*by, F.col("c").alias("part"), F.col("part").alias("__to"))
            hook = checkpointed(hook.join(further, [*by, "part"], "left").select(*by, "c", F.coalesce("__to", "part").alias("part"), F.col("__to").isNotNull().alias("moved")))
            if hook.where("moved").isEmpty():
                break
            hook = hook.drop("moved")
        hook = hook.drop("moved")
        onward = hook.select(*by, F.col("c").alias("part"), F.col("part").alias("__to"))
        if found is not None:
            found = found.join(onward, [*by, "part"], "left").select(*by, "c", F.coalesce("__to", "part").alias("part")).unionByName(hook)
        else:
            found = hook
        for end in ("u", "v"):
            edges = edges.join(hook.select(*by, F.col("c").alias(end), F.col("part").alias("__to")), [*by, end], "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
        edges = checkpointed(edges.where("u <> v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return found


def connected_parts(cells: DataFrame, by: list[str], diagonal: bool = True) -> DataFrame:
    """(by, y, x, part) of every distinct cell; part is the first cell, in reading order, that it is connected with: y * 2**31 + x.

    Tiles of 64 by 64 cells are labelled each by itself. Only cells at tiles' borders are joined with their neighbours, and
    the labels that meet there are merged, so a part may be of any size. Coordinates are integers from 0 to 2**31 - 1.
    """
    cells = cells.select(*by, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x")).distinct()
    schema = T.StructType([*cells.schema.fields, T.StructField("c", T.LongType())])
    tiled = cells.withColumns({"__ty": F.expr(f"y div {TILE}"), "__tx": F.expr(f"x div {TILE}")}).groupBy(*by, "__ty", "__tx")
    tiles = checkpointed(tiled.applyInPandas(_tile_labels(by, diagonal), schema))
    merged = _merged(_across_tiles(tiles, by, diagonal), by)
    if merged is None:
        return tiles.withColumnRenamed("c", "part")
    return tiles.join(merged, [*by, "c"], "left").select(*by, "y", "x", F.coalesce("part", "c").alias("part"))
