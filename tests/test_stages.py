"""A match from pictures to the joined result: all stages, lost runs, resuming, inputs that are missing."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchgrid import schema
from pitchgrid.functions import pixels
from pitchgrid.functions.pictures import png
from pitchgrid.plans import config, stages
from pitchgrid.sources import manifest
from pitchgrid.sources.pictures import frame_counts, list_pictures, write_pictures

WEIGHTS = np.random.default_rng(1).normal(0, 1, (5, 65))
OPTIONS = config.load(config.VelocityConfig, json.dumps({"opening_size": 1}))
SHIRTS = [(200, 30, 30), (30, 30, 200)]


def frame(k):
    rgb = np.full((16, 16, 3), (40, 150, 50), np.uint8)
    rgb[4:10, 2:8], rgb[4:10, 10:16] = SHIRTS[k % 2], SHIRTS[1 - k % 2]
    return rgb


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("match"))
    flow = np.full((16, 16), 200, np.uint8)
    rows = [(m, h, s, k, png(frame(k) if s == "frames" else flow)) for m in ("a b", "c") for h in (1, 2) for k in range(3) for s in ("frames", "u", "v")]
    write_pictures(spark.createDataFrame(rows, "match string, half int, series string, number int, data binary"), root)
    listing = list_pictures(spark, root).cache()
    line = [[(1, 1), (4, 1), (4, 4), (1, 4)]]
    people = [(m, h, k, s, 32 if s == 1 else 0, 0.5, (x, 4.0, x + 6, 10.0), line if s == 0 else []) for m in ("a b", "c") for h in (1, 2) for k in (0, 1) for s, x in ((0, 2.0), (1, 0.0), (2, 10.0))]
    counts = spark.createDataFrame([(m, h, 3) for m in ("a b", "c") for h in (1, 2)], "match_path string, half int, n_flow int")
    return listing, counts, frame_counts(listing), spark.createDataFrame(people, schema.SEGMENTATION)


def run(given, work, root):
    listing, counts, sizes, instances = given
    return stages.run_match(work, root, instances, listing, counts, sizes, WEIGHTS, OPTIONS, config.LabelConfig(erosion_radius=1), with_overlays=False)


def test_from_files_to_result(spark, given, tmp_path):
    work, root = given[2].select("match", "half"), str(tmp_path)
    first = run(given, work.where("match = 'c' and half = 1"), root).collect()
    assert len(first) == 2 * 2 + 1 and {r.match for r in first} == {"c"}
    versions = {(r.match, r.half): r.version for r in manifest.published(spark, root, stages.RESULT).collect()}
    rows = run(given, work, root).collect()
    assert {(r.match, r.half): r.version for r in manifest.published(spark, root, stages.RESULT).collect()}["c", 1] == versions["c", 1]
    assert len(rows) == 4 * (2 * 2 + 1) and sum(r.person_idx is None and r.bbox is None and r.vx is None and r.logits is None for r in rows) == 4
    assert {r.frame_idx for r in rows if r.person_idx is None} == {2}
    for r in rows:
        if r.person_idx is not None:
            cut = frame(r.frame_idx)[4:10, 2:8] if r.person_idx == 0 else frame(r.frame_idx)[4:10, 10:16]
            hist = pixels.colour_histogram(cut, np.ones((6, 6), bool), "ab")  # shirts have one colour, so the outline's inside has it as well
            assert np.allclose(r.logits, WEIGHTS[:, :-1] @ hist + WEIGHTS[:, -1], atol=1e-5) and abs(r.vx) < 1e-6
    assert manifest.unfinished(work, root, stages.RESULT).count() == 0


def test_a_stage_waits_for_its_inputs_and_a_lost_run_is_made_up_for(spark, given, tmp_path, monkeypatch):
    listing, counts, sizes, instances = given
    work, root = sizes.select("match", "half").where("match = 'c'"), str(tmp_path)
    stages.join_stage(work, root, sizes)
    stages.velocity_stage(work, root, listing, counts, sizes, OPTIONS, with_overlays=False)
    assert manifest.unfinished(work, root, stages.VELOCITY).count() == 2  # nothing is segmented
    stages.segmentation_stage(work.where("half = 2"), root, instances)
    with monkeypatch.context() as m:
        m.setattr(manifest, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            stages.velocity_stage(work, root, listing, counts, sizes, OPTIONS, with_overlays=False)
    assert stages.results(work, root).count() == 0
    stages.velocity_stage(work, root, listing, counts, sizes, OPTIONS, with_overlays=False)
    assert [(r.match, r.half) for r in manifest.published(spark, root, stages.VELOCITY).collect()] == [("c", 2)]
    got = run(given, work, root)
    assert got.count() == 10 and got.where("vx is not null").count() == 8


def test_no_work_and_no_people(spark, given, tmp_path):
    listing, counts, sizes, instances = given
    work = sizes.select("match", "half").where("match = 'c'")
    assert run(given, work.where("half > 2"), str(tmp_path / "none")).count() == 0
    rows = run((listing, counts, sizes, instances.where("class_id = 32")), work, str(tmp_path / "balls")).collect()
    assert len(rows) == 6 and all(r.person_idx is None for r in rows)


def test_pictures_are_not_shuffled(spark, given):
    listing, _, _, instances = given
    people = instances.where("class_id = 0").withColumn("person_idx", F.col("seg_idx"))
    plan = stages.person_histograms(people, listing)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "Exchange" not in plan.split("MapInArrow")[0]
