"""Registered queries that write the files of matches from whole tables and read them by the engine's own readers.

Frames are customers or orders, 100 to a half and two halves to a match; some have no box, region or calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchgrid import adapters as A
from pitchgrid.adapters import table, with_sql
from pitchgrid.functions import geometry as G
from pitchgrid.functions.pictures import png
from pitchgrid.plans.registry import query
from pitchgrid.sources import annotations, readers
from pitchgrid.sources.pictures import FILES_PER_TASK, list_pictures, write_files, write_pictures
from pitchgrid.sources.shared import new_path, spread
from pitchgrid.sources.worklist import list_matches

#: Where annotated pictures are said to lie; documents hold this path.
PLACE = "/data/all matches"


def _place(key: Column) -> list[Column]:
    """(match, half, frame_idx) of a number."""
    match = F.concat(F.lit("match "), F.floor(key / 200).cast("string"))
    return [match.alias("match"), (F.floor(key / 100) % 2 + 1).cast("int").alias("half"), (key % 100).cast("int").alias("frame_idx")]


def _place_sql(key: str) -> str:
    return f"'match ' || ({key} // 200) AS match, ({key} // 100 % 2 + 1)::INT AS half, ({key} % 100)::INT AS frame_idx"


def _written_halves(rows: DataFrame, predictions: Column, name: str) -> str:
    """rows(match, half, frame_idx, ...) as one JSON file per half; the folder they are in."""
    root = new_path(rows.sparkSession, "halves")
    halves = rows.groupBy("match", "half").agg(F.array_sort(F.collect_list(F.struct("frame_idx", predictions.alias("p")))).alias("a"))
    value = F.to_json(F.struct(F.transform("a", lambda x: x["p"]).alias("predictions")))
    write_files(halves.select(F.format_string(f"%s/%d_{name}.json", "match", "half").alias("name"), value.alias("data")), root)
    return root


@query(with_sql("det") + f"SELECT {_place_sql('frame_idx')}, (row_number() OVER (PARTITION BY frame_idx ORDER BY det_idx) - 1)::INT AS det_idx, x1, y1, x2, y2, q % 2 = 0 AS onfield FROM det WHERE q > 30")
def detection_scan(spark, d):
    """Boxes from one file per half; frames without a box hold their place in it."""
    b = F.col("bbox")
    boxes = A.detections(spark, d).where("q > 30").select("frame_idx", F.struct("det_idx", F.array(*[b[c] for c in ("x1", "y1", "x2", "y2")]).alias("b"), (F.col("q") % 2 == 0).alias("f")).alias("e"))
    frames = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_idx")).join(boxes, "frame_idx", "left").groupBy("frame_idx").agg(F.array_sort(F.collect_list("e")).alias("e"))
    parts = F.struct(F.transform("e", lambda x: x["b"]).alias("bboxes"), F.transform("e", lambda x: x["f"]).alias("onfield"))
    root = _written_halves(frames.select(*_place(F.col("frame_idx")), "e"), parts, "player_boxes")
    rows = readers.read_detections(spark, f"{root}/*/*.json")
    return rows.select("match", "half", "frame_idx", "det_idx", "bbox.*", "onfield")


@query(
    f"""SELECT {_place_sql("frame_idx")}, CASE WHEN c % 4 > 0 THEN confidence END AS confidence, CASE WHEN c % 4 > 0 THEN h[1] END AS first, CASE WHEN c % 4 > 0 THEN h[3] END AS third
    FROM (SELECT o_orderkey AS frame_idx, o_custkey AS c, o_custkey % 100 / 100.0 AS confidence, [1 + o_custkey % 3 * 0.01::DOUBLE, 0, 53 + o_custkey % 5] AS h FROM orders)"""
)
def calibration_scan(spark, d):
    """The first calibration of each frame from one file per half; a quarter of the frames have none."""
    one = F.struct("confidence", "homography")
    decoy = F.struct(F.lit(0.0).alias("confidence"), F.transform("homography", lambda x: -x).alias("homography"))
    rows = A.calibration(spark, d).select(*_place(F.col("frame_idx")), F.when(F.col("c") % 4 > 0, F.array(one, decoy)).otherwise(F.slice(F.array(one, decoy), 1, 0)).alias("found"))
    found = readers.read_calibration(spark, f"{_written_halves(rows, F.col('found'), 'calibration')}/*/*.json")
    return found.select("match", "half", "frame_idx", "confidence", F.get("homography", F.lit(0)).alias("first"), F.get("homography", F.lit(2)).alias("third"))


def _frame_pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    y, x = np.indices((4, 6))
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            image = np.stack([r["key"] % 200 + x, r["key"] // 7 % 200 + y, np.full_like(x, 50)], axis=-1)[:, : 4 + r["half"]]
            rows.append({c: r[c] for c in ("match", "half")} | {"series": "frames", "number": r["frame_idx"], "data": png(image.astype(np.uint8))})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("match", pa.string()), ("half", pa.int32()), ("series", pa.string()), ("number", pa.int32()), ("data", pa.binary())]))


@query(
    f"""WITH k AS (SELECT c_custkey AS key, {_place_sql("c_custkey")} FROM customer),
    px AS (SELECT k.*, y, x, unnest([0, 1, 2]) AS c, unnest([50, key // 7 % 200 + y, key % 200 + x]) AS v FROM k, range(4) a(y), range(6) b(x) WHERE x < 4 + half)
    SELECT match, half, frame_idx, 4 AS height, 4 + half AS width, max(4 + half) OVER (PARTITION BY match, half) AS first_width, sha256(string_agg(lower(printf('%02x', v::INT)), '' ORDER BY y, x, c)) AS digest FROM px GROUP BY match, half, frame_idx"""
)
def frame_scan(spark, d):
    """Frames' pictures read back whole, beside the width of their half's first one."""
    root, key = new_path(spark, "frames"), F.col("c_custkey")
    rows = table(spark, d, "customer").select(*_place(key), key.cast("bigint").alias("key"))
    write_pictures(spread(rows, FILES_PER_TASK).mapInArrow(_frame_pictures, "match string, half int, series string, number int, data binary"), root)
    listing = list_pictures(spark, root)
    sizes = readers.frame_size(listing).select("match", "half", F.col("width").alias("first_width"))
    digest = F.sha2(F.lower(F.hex("data")).cast("binary"), 256).alias("digest")
    frames = readers.read_frames(listing).select("match", "half", "frame_idx", "height", "width", digest)
    return frames.join(sizes, ["match", "half"]).select("match", "half", "frame_idx", "height", "width", "first_width", "digest")


@query("SELECT 'l' || s_suppkey % 3 || '/s' || s_suppkey % 5 || '/m ' || s_suppkey AS match FROM supplier")
def match_listing(spark, d):
    """Folders of matches, three levels deep; a file a level higher is none."""
    root, key = new_path(spark, "matches"), F.col("s_suppkey")
    match = F.format_string("l%d/s%d/m %d/1_boxes.json", key % 3, key % 5, key)
    stray = F.format_string("l%d/s%d/%d.json", key % 3, key % 5, key)
    write_files(spread(table(spark, d, "supplier"), FILES_PER_TASK).select(F.explode(F.array(match, stray)).alias("name"), F.lit("{}").alias("data")), root)
    return list_matches(spark, root)


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    """The annotation files of all customers as frames, with their orders as boxes."""
    order = W.partitionBy("o_custkey").orderBy("o_orderkey")
    k = F.col("o_orderkey")
    x, y = k % 40 * 8, k % 10 * 16
    boxes = table(spark, d, "orders").where("o_custkey % 10 > 0").select(
        *_place(F.col("o_custkey")), F.row_number().over(order).alias("box_idx"), (k % 5).cast("int").alias("category"), G.box(x, y, x + 40 + k % 30, y + 80 + k % 40).alias("bbox")
    )
    frames = table(spark, d, "customer").select(*_place(F.col("c_custkey")), F.lit(720).alias("height"), F.lit(1280).alias("width"))
    return annotations.annotation_files(frames, boxes, PLACE, "people")


_BOXES = f"""bx AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, (o_orderkey % 5)::INT AS category, (o_orderkey % 40 * 8)::DOUBLE AS x1, (o_orderkey % 10 * 16)::DOUBLE AS y1,
    (o_orderkey % 40 * 8 + 40 + o_orderkey % 30)::DOUBLE AS x2, (o_orderkey % 10 * 16 + 80 + o_orderkey % 40)::DOUBLE AS y2 FROM orders WHERE o_custkey % 10 > 0)"""
_READ = f"WITH {_BOXES} SELECT {_place_sql('key').rpartition(', ')[0]}, lpad((key % 100 + 1)::VARCHAR, 5, '0') AS asset, (i - 1)::INT AS region_idx, category, x1, y1, x2, y2 FROM bx JOIN customer ON c_custkey = key"


def _uuid_sql(role: str) -> str:
    h = f"sha256('people/' || match || '/' || half || '/{role}')"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def _connection_sql(name: str, folder: str, role: str) -> str:
    return f"{{'name': {name}, 'providerType': 'localFileSystemProxy', 'providerOptions': {{'folderPath': '{PLACE}/' || match || '/' || half || '_HQ/{folder}', 'relativePath': true}}, 'id': {_uuid_sql(role)}}}"


@query(
    f"""WITH {_BOXES},
    fr AS (SELECT c_custkey AS key, {_place_sql("c_custkey")}, lpad((c_custkey % 100 + 1)::VARCHAR, 5, '0') AS id FROM customer),
    a AS (SELECT *, {{'format': 'jpg', 'id': id, 'name': id || '.jpg', 'path': 'file:' || replace('{PLACE}/' || match || '/' || half || '_HQ/frames/' || id || '.jpg', ' ', '%20'), 'size': {{'width': 1280, 'height': 720}}, 'state': 1, 'type': 1}} AS asset FROM fr),
    r AS (SELECT key, string_agg(to_json({{'id': lpad(i::VARCHAR, 5, '0'), 'type': 'RECTANGLE', 'tags': [['Referee', 'Team A', 'Team B', 'Goalkeeper 1', 'Goalkeeper 2'][category + 1]],
      'boundingBox': {{'left': x1, 'top': y1, 'height': y2 - y1, 'width': x2 - x1}}, 'points': [{{'x': x1, 'y': y1}}, {{'x': x2, 'y': y1}}, {{'x': x2, 'y': y2}}, {{'x': x1, 'y': y2}}]}})::VARCHAR, ',' ORDER BY i) AS regions FROM bx GROUP BY key)
    SELECT match || '/' || half || '_HQ/annotations/' || id || '-asset.json' AS name, '{{"asset":' || to_json(asset)::VARCHAR || ',"regions":[' || coalesce(regions, '') || ']}}' AS value FROM a LEFT JOIN r USING (key)
    UNION ALL SELECT match || '/' || half || '_HQ/annotations/people.vott', rtrim(to_json({{'name': 'people', 'sourceConnection': {_connection_sql("match", "frames", "source")},
      'targetConnection': {_connection_sql("match || ' Annotations'", "annotations", "target")}, 'videoSettings': {{'frameExtractionRate': 2}},
      'tags': [{{'name': 'Referee', 'color': '#000000'}}, {{'name': 'Team A', 'color': '#015cda'}}, {{'name': 'Team B', 'color': '#ff123b'}}, {{'name': 'Goalkeeper 1', 'color': '#6917aa'}}, {{'name': 'Goalkeeper 2', 'color': '#70c400'}}],
      'useSecurityToken': false, 'id': {_uuid_sql("project")}, 'activeLearningSettings': {{'autoDetect': false, 'predictTag': true, 'modelPathType': 'coco'}},
      'exportFormat': {{'providerType': 'vottJson', 'providerOptions': {{'assetState': 'visited', 'includeImages': true}}}}, 'version': '2.2.0'}})::VARCHAR, '}}') || ',"assets":{{' || string_agg('"' || id || '":' || to_json(asset)::VARCHAR, ',' ORDER BY frame_idx) || '}}}}'
    FROM a GROUP BY match, half"""
)
def annotation_project(spark, d):
    """The annotation folder of every half: a document per frame and the project, byte for byte."""
    return _annotated(spark, d)


@query(_READ)
def annotation_tree_scan(spark, d):
    """These folders written, and the regions read from all of their documents."""
    root = new_path(spark, "annotations")
    write_files(_annotated(spark, d).select("name", F.col("value").alias("data")), root)
    return annotations.read_annotation_tree(spark, root).select("match", "half", "asset", "region_idx", "category", "bbox.*")


@query(f"SELECT asset, region_idx, category, x1, y1, x2, y2 FROM ({_READ})")
def annotation_export_scan(spark, d):
    """The same regions from one export per half."""
    root = new_path(spark, "exports")
    documents = _annotated(spark, d).where("endswith(name, '-asset.json')").select(F.regexp_extract("name", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("name", r"([^/]+)-asset.json$", 1).alias("id"), "value")
    entries = F.array_sort(F.collect_list(F.concat(F.lit('"'), "id", F.lit('":'), "value")))
    exports = documents.groupBy("folder").agg(F.concat(F.lit('{"assets":{'), F.concat_ws(",", entries), F.lit("}}")).alias("data"))
    write_files(exports.select(F.concat("folder", F.lit("/export.json")).alias("name"), "data"), root)
    return annotations.read_annotation_export(spark, f"{root}/*/*/*/export.json").select("asset", "region_idx", "category", "bbox.*")
