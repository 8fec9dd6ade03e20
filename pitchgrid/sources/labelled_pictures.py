"""Labelled pictures: a folder per class, and training copies of each picture that can be made again.

Files lie in {label}/{name} below a root. Every copy of a picture has its draws in the plan, digests of (seed, label, name,
copy), so that a repeated task, another cluster or another partitioning makes the same pixels; no generator is carried from
row to row. Draws and paths move through the plan; pixels are made by the task that opens the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchgrid.functions.augment import Recipe, coloured, resized, training_picture
from pitchgrid.functions.pictures import decoded
from pitchgrid.sources.pictures import list_files, opened, write_files

#: A batch of pixels is handed on at about this many bytes.
BATCH_BYTES = 8 << 20
#: A task makes about this many pictures; by their paths' few bytes alone, thousands would come into one task.
TASK_PICTURES = 500
PIXELS = "label string, name string, category int, copy int, height int, width int, pixels binary"
PIXELS_ARROW = pa.schema([("label", pa.string()), ("name", pa.string()), *[(c, pa.int32()) for c in ("category", "copy", "height", "width")], ("pixels", pa.binary())])


def list_labelled(spark: SparkSession, root: str, classes: list[str] | None = None) -> DataFrame:
    """(label, name, category, path) of the pictures below root; only names are read.

    A class's number is the place of its folder among all folders in the order of names, or in ``classes``, which may name
    folders without pictures; pictures of other folders are left out then. The listing is written once.
    """
    path = list_files(spark, root, 1).where(F.col("path").rlike(r"\.(png|jpg|jpeg|PNG|JPG|JPEG)$"))
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)$", k)
    rows = path.select(part(1).alias("label"), part(2).alias("name"), "path")
    if classes is not None:
        numbers = spark.createDataFrame(list(zip(classes, range(len(classes)), strict=True)), "label string, category int")
    else:
        numbers = rows.select("label").distinct().select("label", (F.row_number().over(W.orderBy("label")) - 1).cast("int").alias("category"))
    return rows.join(numbers, "label").select("label", "name", "category", "path")


def draws(seed: int, *key: Column) -> Column:
    """Five whole numbers below 2^32 from a digest of the seed and the key, the same on every cluster."""
    text = F.concat_ws("/", F.lit(str(seed)), *[k.cast("string") for k in key])
    digest = F.sha2(text.cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(5)])


def _spread(listing: DataFrame, copies: int) -> DataFrame:
    return listing.repartition(max(1, -(-listing.count() * copies // TASK_PICTURES)), "path")


def _made(listing: DataFrame, make) -> DataFrame:
    """The pixels of each row of (label, name, category, copy, path, draws); rows of one path in a row open it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, image, rows, held = None, None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != last:
                    last, image = r["path"], coloured(decoded(opened(r["path"])))
                out = make(image, r["draws"])
                rows.append({c: r[c] for c in ("label", "name", "category", "copy")} | {"height": out.shape[0], "width": out.shape[1], "pixels": out.tobytes()})
                held += out.size
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, PIXELS_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, PIXELS_ARROW)

    return listing.select("label", "name", "category", "copy", "path", "draws").mapInArrow(run, PIXELS)


def training_pictures(listing: DataFrame, copies: int, seed: int, recipe: Recipe | None = None, first: int = 0) -> DataFrame:
    """(label, name, category, copy, height, width, pixels): copies ``first`` to ``first + copies - 1`` of each picture, changed by their draws.

    pixels are RGB bytes by row. A copy depends on the seed, the label, the file's name and its number alone: epoch k takes
    copy k. A file that is no picture fails its task.
    """
    if copies < 1:
        raise ValueError("at least one copy")
    recipe = recipe or Recipe()
    each = _spread(listing, copies).withColumn("copy", F.explode(F.sequence(F.lit(first), F.lit(first + copies - 1))))
    each = each.withColumn("draws", draws(seed, F.col("label"), F.col("name"), F.col("copy")))
    return _made(each, lambda image, drawn: training_picture(image, drawn, recipe))


def evaluation_pictures(listing: DataFrame, side: int = Recipe.cropped) -> DataFrame:
    """The same columns, copy 0: each picture resized to a square of ``side``, whatever its shape, and not changed otherwise."""
    each = _spread(listing, 1).withColumns({"copy": F.lit(0), "draws": F.lit(None).cast("array<bigint>")})
    return _made(each, lambda image, _: resized(image, side, side))


def write_labelled(rows: DataFrame, root: str) -> int:
    """Writes rows(label, name, data) as {label}/{name} below root and returns how many."""
    return write_files(rows.select(F.concat_ws("/", "label", "name").alias("name"), "data"), root)
