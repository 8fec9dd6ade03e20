"""Reading and writing of box annotations: assets with tagged regions, and the project that lists them, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid import schema
from pitchgrid.functions.geometry import corners
from pitchgrid.sources.pictures import file_contents, list_files

# Tags of the annotation tool and their colours
TAGS = {"Referee": 0, "Team A": 1, "Team B": 2, "Goalkeeper 1": 3, "Goalkeeper 2": 4}

COLOURS = {"Referee": "#000000", "Team A": "#015cda", "Team B": "#ff123b", "Goalkeeper 1": "#6917aa", "Goalkeeper 2": "#70c400"}


def tag_category(tag: Column, tags: dict[str, int] | None = None) -> Column:
    """The class of a tag; null for others."""
    out = F.lit(None).cast("int")
    for name, number in (tags or TAGS).items():
        out = F.when(tag == name, number).otherwise(out)
    return out


def regions_of(rows: DataFrame, tags: dict[str, int] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, asset, region_idx, category, bbox) of rows(keys, name, regions); rows without regions are left out."""
    each = rows.where(F.size("regions") > 0).select(*keys, "name", F.posexplode("regions").alias("region_idx", "r"))
    b = F.col("r.boundingBox")
    name = F.expr("substring(name, 1, length(name) - 4)")
    return each.select(
        *keys, name.alias("asset"), "region_idx", tag_category(F.get("r.tags", F.lit(0)), tags).alias("category"),
        corners(b["left"], b["top"], b["width"], b["height"]).alias("bbox"),
    )


def read_annotation_dir(spark: SparkSession, path: str, tags: dict[str, int] | None = None) -> DataFrame:
    """(asset, region_idx, category, bbox) from one JSON file per asset; assets without regions have no rows."""
    return regions_of(_annotations(spark, path).select(F.col("asset.name").alias("name"), "regions"), tags)


def read_annotation_tree(spark: SparkSession, root: str, tags: dict[str, int] | None = None) -> DataFrame:
    """The same with match and half from all annotation folders match/{half}_HQ/annotations below root; tasks list and open the documents."""
    part = lambda k: F.regexp_extract("path", r"/([^/]+)/(\d)_HQ/annotations/[^/]+-asset\.json$", k)
    named = list_files(spark, root).select(part(1).alias("match"), part(2).try_cast("int").alias("half"), "path").where("half is not null")
    document = F.from_json(F.col("data").cast("string"), schema.ANNOTATION, {"mode": "FAILFAST"})
    rows = file_contents(named).select("match", "half", document.alias("d")).select("match", "half", F.col("d.asset.name").alias("name"), "d.regions")
    return regions_of(rows, tags, ("match", "half"))


def _annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ANNOTATION).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*-asset.json").json(path)


def read_annotation_export(spark: SparkSession, path: str, tags: dict[str, int] | None = None) -> DataFrame:
    """The same from a single export with a map of assets."""
    rows = spark.read.schema(schema.ANNOTATION_EXPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    each = rows.select(F.explode(F.map_values("assets")).alias("a"))
    return regions_of(each.select(F.col("a.asset.name").alias("name"), F.col("a.regions").alias("regions")), tags)


def annotation_json(boxes: DataFrame, tags: dict[str, int] | None = None) -> DataFrame:
    """(asset, value): one JSON document per asset of boxes(asset, category, bbox), regions in the order of category and corners."""
    per_asset = boxes.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("category", "bbox"))).alias("boxes"))
    return per_asset.select("asset", F.to_json(_fields({"asset": {"name": F.concat("asset", F.lit(".jpg"))}, "regions": _regions("boxes", tags)})).alias("value"))


def _fields(value) -> Column:
    """A column with the shape of nested dictionaries, lists, columns and constants."""
    if isinstance(value, dict):
        return F.struct(*[_fields(v).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        return F.array(*[_fields(v) for v in value])
    return value if isinstance(value, Column) else F.lit(value)


def _regions(boxes: str, tags: dict[str, int] | None) -> Column:
    """The regions of an array of (category, bbox), numbered from 1 in its order."""
    names = F.create_map(*[F.lit(x) for name, k in (tags or TAGS).items() for x in (k, name)])

    def region(row: Column, i: Column) -> Column:
        b = row["bbox"]
        point = lambda x, y: {"x": b[x], "y": b[y]}
        return _fields({
            "id": F.format_string("%05d", i + 1), "type": "RECTANGLE", "tags": [names[row["category"]]],
            "boundingBox": {"left": b["x1"], "top": b["y1"], "height": b["y2"] - b["y1"], "width": b["x2"] - b["x1"]},
            "points": [point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2")],
        })

    return F.transform(boxes, region)


def _id(*key: Column) -> Column:
    """A digest of the key in the form of an identifier, the same in each run."""
    h = F.sha2(F.concat_ws("/", *key).cast("binary"), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def annotation_files(frames: DataFrame, boxes: DataFrame, root: str, project: str, tags: dict[str, int] | None = None) -> DataFrame:
    """(name, value): the annotation folder of each half as JSON documents, named below root, which tells where pictures lie.

    One document per row of frames(match, half, frame_idx, height, width), frames without boxes included, with the regions of
    boxes(match, half, frame_idx, box_idx, category, bbox) in the order of box_idx; and one project per half, which lists its
    frames. A project is one document, so one half's frames (not their boxes) come together in one task.
    """
    keys = ["match", "half", "frame_idx"]
    each = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("box_idx", "category", "bbox"))).alias("boxes"))
    own = F.concat(F.col("match"), F.lit("/"), F.col("half").cast("string"), F.lit("_HQ/"))
    number, pictures = F.format_string("%05d", F.col("frame_idx") + 1), F.concat(F.lit(f"{root}/"), own, F.lit("frames"))
    asset = _fields({
        "format": "jpg", "id": number, "name": F.concat(number, F.lit(".jpg")),
        "path": F.replace(F.concat(F.lit("file:"), pictures, F.lit("/"), number, F.lit(".jpg")), F.lit(" "), F.lit("%20")),
        "size": {"width": F.col("width"), "height": F.col("height")}, "state": 1, "type": 1,
    })
    named = frames.select(*keys, asset.alias("asset"))
    none = F.array().cast("array<struct<box_idx:int,category:int,bbox:struct<x1:double,y1:double,x2:double,y2:double>>>")
    whole = named.join(each, keys, "left").withColumn("boxes", F.coalesce("boxes", none))
    document = F.to_json(_fields({"asset": F.col("asset"), "regions": _regions("boxes", tags)}))
    assets = whole.select(F.concat(own, F.lit("annotations/"), F.col("asset.id"), F.lit("-asset.json")).alias("name"), document.alias("value"))
    halves = named.groupBy("match", "half").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "asset"))).alias("a"))
    listed = F.map_from_entries(F.transform("a", lambda x: F.struct(x["asset"]["id"], x["asset"])))
    this = lambda role: _id(F.lit(project), F.col("match"), F.col("half").cast("string"), F.lit(role))

    def folder(name: Column, place: Column, role: str) -> dict:
        return {"name": name, "providerType": "localFileSystemProxy", "providerOptions": {"folderPath": place, "relativePath": True}, "id": this(role)}

    # The project file of the annotation tool
    text = _fields({
        "name": project,
        "sourceConnection": folder(F.col("match"), pictures, "source"),
        "targetConnection": folder(F.concat("match", F.lit(" Annotations")), F.concat(F.lit(f"{root}/"), own, F.lit("annotations")), "target"),
        "videoSettings": {"frameExtractionRate": 2},
        "tags": [{"name": name, "color": COLOURS.get(name, "#ffffff")} for name in tags or TAGS],
        "useSecurityToken": False,
        "id": this("project"),
        "activeLearningSettings": {"autoDetect": False, "predictTag": True, "modelPathType": "coco"},
        "exportFormat": {"providerType": "vottJson", "providerOptions": {"assetState": "visited", "includeImages": True}},
        "version": "2.2.0",
        "assets": listed,
    })
    return assets.unionByName(halves.select(F.concat(own, F.lit(f"annotations/{project}.vott")).alias("name"), F.to_json(text).alias("value")))
