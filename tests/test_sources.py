"""Readers and writers on small hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from pitchgrid.plans import config
from pitchgrid.sources import annotations, readers, sinks, worklist


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_detections_and_calibration(spark, tmp_path):
    found = {"predictions": [{"bboxes": [[1, 2, 3, 4], [5, 6, 7, 8]], "onfield": [True, False]}, {"bboxes": [], "onfield": []}]}
    p = write(tmp_path / "match a" / "2_player_boundingbox_maskrcnn.json", found)
    rows = readers.read_detections(spark, p).collect()
    assert [(r.match, r.half, r.frame_idx, r.det_idx, r.bbox.x2, r.onfield) for r in rows] == [("match a", 2, 0, 0, 3.0, True), ("match a", 2, 0, 1, 7.0, False)]
    first, second = {"confidence": 0.9, "homography": [1.0] * 9}, {"confidence": 0.1, "homography": [2.0] * 9}
    p = write(tmp_path / "m" / "1_field_calib_ccbv.json", {"predictions": [[first, second], []]})
    rows = readers.read_calibration(spark, p).orderBy("frame_idx").collect()
    assert [(r.half, r.confidence) for r in rows] == [(1, 0.9), (1, None)]


def test_tables_of_numbers(spark, tmp_path):
    p = write(tmp_path / "n.csv", "match_path,num_frames_first_half,num_frames_second_half\na/b,10,20\n")
    assert sorted(tuple(r) for r in readers.read_flow_counts(spark, p).collect()) == [("a/b", 1, 10), ("a/b", 2, 20)]
    p = write(tmp_path / "s.csv", "match_path,SAR\na,4:3\nb,1:1\nc,N/A\nd,1:0\n")
    got = dict(tuple(r) for r in readers.read_aspect_ratios(spark, p).collect())
    assert got == {"a": 4 / 3, "b": 1.0, "c": 1.0, "d": None}


def test_annotations_round_trip(spark, tmp_path):
    rows = [("00001", 3, (1.0, 2.0, 11.0, 22.0)), ("00001", 0, (0.0, 0.0, 5.0, 5.0)), ("00002", 1, (3.0, 3.0, 4.0, 4.0))]
    boxes = spark.createDataFrame(rows, "asset string, category int, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    assets = {r.asset: json.loads(r.value) for r in annotations.annotation_json(boxes).collect()}
    assert all(len(x["points"]) == 4 and x["id"] for a in assets.values() for x in a["regions"])
    for name, value in {**assets, "empty": {"asset": {"name": "00009.jpg"}, "regions": []}}.items():
        write(tmp_path / "dir" / f"{name}-asset.json", value)
    whole = write(tmp_path / "export.json", {"assets": assets})
    for got in (annotations.read_annotation_dir(spark, str(tmp_path / "dir")), annotations.read_annotation_export(spark, whole)):
        assert sorted((r.asset, r.category, tuple(r.bbox)) for r in got.collect()) == sorted(rows)


def test_worklist_and_resume(spark, tmp_path):
    p = write(tmp_path / "w.txt", "a/b \nc/d\n\n")
    work = worklist.read_worklist(spark, p)
    assert [r.path for r in worklist.pending(work, spark.createDataFrame([("c/d",)], "path string"), ["path"]).collect()] == ["a/b"]
    assert spark.range(1).select(worklist.output_path(F.lit("m"), "join")).first()[0] == "m/results"


def test_stage_writes_replace_their_partitions_alone(spark, tmp_path):
    out = str(tmp_path / "stage")
    sinks.write_stage(spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "match string, half int, v int"), out)
    sinks.write_stage(spark.createDataFrame([("b", 1, 7)], "match string, half int, v int"), out)
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [5, 7]
    split = spark.createDataFrame([("train", 1, 1), ("valid", 2, 2)], "split string, category int, v int")
    sinks.write_split(split, str(tmp_path / "split"))
    sinks.write_split(split.limit(1), str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).count() == 1


def test_gather_repaired(spark):
    frames = spark.createDataFrame([(1, i, f"f{i}") for i in range(6)], "half int, frame_idx int, v string")
    index = spark.createDataFrame([(1, 0, 4), (1, 1, 4), (1, 2, -1)], "half int, frame_idx int, all_frame_idx int")
    assert sorted((r.frame_idx, r.v) for r in sinks.gather_repaired(frames, index, ["half"]).collect()) == [(0, "f4"), (1, "f4")]


def test_match_listing_and_configs(spark, tmp_path):
    write(tmp_path / "league" / "season" / "match" / "1_x.json", {})
    write(tmp_path / "league" / "readme.json", {})
    assert [r.match for r in worklist.list_matches(spark, str(tmp_path)).collect()] == ["league/season/match"]
    assert config.load(config.VelocityConfig, '{"region_clusters": 6}').region_clusters == 6
    with pytest.raises(ValueError, match="unknown"):
        config.load(config.TrainingConfig, '{"epochs": 6}')


def test_times_of_day_and_back(spark):
    import datetime

    from pitchgrid.functions.clock import clock_seconds, clock_text

    given = [0.0, 59.0, 3600.5, 86399.999999, 86400.0, 200000.25]
    rows = spark.createDataFrame([(x,) for x in given] + [(None,)], "s double").withColumn("t", clock_text(F.col("s")))
    got = {r.s: (r.t, r.back) for r in rows.withColumn("back", clock_seconds(F.col("t"))).collect()}
    assert got.pop(None) == (None, None)
    for x, (t, back) in got.items():
        assert t == str(datetime.timedelta(seconds=x)) and abs(back - x) < 1e-6
    assert spark.sql("select 'half past nine' as t").select(clock_seconds(F.col("t"))).first()[0] is None


def test_files_are_listed_and_opened_by_tasks(spark, tmp_path):
    """Names come from tasks, level by level, and neither a file of names nor a scan of few files each is left in the plan."""
    from pitchgrid.sources import pictures

    names = ["top.json", "m 1/1_HQ/frames/00001.png", "m 1/1_HQ/frames/deep/er/x.json", "m 1/1_HQ/_draft", "m%202/2_HQ/u/000000.png", ".hidden/a.json", "l/s/m/1_x.json", "l/s/m/_2_x.json"]
    pictures.write_files(spark.createDataFrame([(n, "{}") for n in names], "name string, data string"), str(tmp_path))
    (tmp_path / "empty").mkdir()
    for levels in (0, 1, 3):
        listed = pictures.list_files(spark, f"{tmp_path}/", levels)
        assert sorted(r.path for r in listed.collect()) == sorted(f"{tmp_path}/{n}" for n in names if "_draft" not in n and "hidden" not in n and "/_2" not in n)
        assert "FileScan" not in listed._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[:4] for r in pictures.list_pictures(spark, str(tmp_path)).orderBy("series").collect()] == [("m 1", 1, "frames", 0), ("m%202", 2, "u", 0)]
    assert [r.match for r in worklist.list_matches(spark, f"{tmp_path}/").collect()] == ["l/s/m"]
    assert pictures.list_files(spark, str(tmp_path / "empty")).count() == 0


def test_frames_are_opened_once_and_files_that_are_none_left_out(spark, tmp_path):
    import numpy as np

    from pitchgrid.functions.pictures import png
    from pitchgrid.sources import pictures

    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    rows = [("m", 1, "frames", 0, bytearray(png(image))), ("m", 1, "frames", 1, bytearray(png(image[:1, :2]))), ("m", 2, "frames", 3, bytearray(b"no picture")), ("m", 2, "frames", 4, bytearray(png(image)[:50]))]
    pictures.write_pictures(spark.createDataFrame(rows, "match string, half int, series string, number int, data binary"), str(tmp_path))
    listing = pictures.list_pictures(spark, str(tmp_path))
    got = sorted(tuple(r) for r in readers.read_frames(listing).collect())
    assert [g[:5] for g in got] == [("m", 1, 0, 2, 4), ("m", 1, 1, 1, 2)] and bytes(got[0][5]) == image[..., ::-1].tobytes()
    assert [tuple(r) for r in readers.frame_size(listing).collect()] == [("m", 1, 2, 4)]


def test_few_rows_of_files_come_to_python_at_a_time(spark, tmp_path):
    from pitchgrid.sources import pictures

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        assert pictures.write_files(spark.range(3).selectExpr("concat('a/', id, '.json') as name", "repeat('x', 1000) as data"), str(tmp_path)) == 3
        assert int(spark.conf.get(name)) <= 1000 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"
    finally:
        spark.conf.set(name, before)


def test_few_rows_of_many_bytes_are_cut_by_bytes_too(spark):
    import pyarrow as pa

    from pitchgrid.sources import shared

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (rows, size)}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    try:
        spark.conf.set(rows, 200)
        spark.conf.set(size, "64MB")
        long = shared.in_small_batches(spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).cast("binary").alias("data")))
        found = long.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in found) == 400 and max(r.bytes for r in found) < 3 << 20 and spark.conf.get(rows) == "200"
        for given, kept in (("1m", "1m"), ("1g", "2m"), ("67108864b", "2m"), ("1000000", "1000000")):
            spark.conf.set(size, given)
            shared.in_small_batches(long)
            assert spark.conf.get(size) == kept
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_writing_task_forgets_folders_and_loses_no_file(spark, tmp_path, monkeypatch):
    from pitchgrid.sources import pictures

    monkeypatch.setattr(pictures, "FOLDERS_KNOWN", 2)
    names = [f"m{i % 5}/{i}.json" for i in range(25)]
    assert pictures.write_files(spark.createDataFrame([(n, n) for n in names], "name string, data string").coalesce(1), str(tmp_path)) == 25
    assert {p.relative_to(tmp_path).as_posix(): p.read_text() for p in tmp_path.rglob("*.json")} == {n: n for n in names}
