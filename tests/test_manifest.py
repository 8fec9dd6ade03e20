"""Runs that are lost between writing and publishing, second runs, and halves without rows."""

import pytest
from pyspark.sql import functions as F

from pitchgrid.sources import manifest

WORK = [("a", 1), ("a", 2), ("b", 1)]


def seen(spark, root, stage="velocity"):
    return sorted(tuple(r) for r in manifest.read_published(spark, root, stage, "v int").select("match", "half", "v").collect())


def test_a_lost_run_is_never_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    work = spark.createDataFrame(WORK, "match string, half int")
    assert seen(spark, root) == [] and manifest.unfinished(work, root, "velocity").count() == 3

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(manifest, "publish", lost)
        with pytest.raises(RuntimeError):
            manifest.run_stage(work, root, "velocity", lambda left: left.withColumn("v", F.lit(-1)))
    assert seen(spark, root) == [] and manifest.unfinished(work, root, "velocity").count() == 3
    manifest.run_stage(work.where("match = 'a'"), root, "velocity", lambda left: left.withColumn("v", F.lit(1)).where("half = 1"))
    assert seen(spark, root) == [("a", 1, 1)]
    asked = []
    manifest.run_stage(work, root, "velocity", lambda left: asked.extend(left.collect()) or left.withColumn("v", F.lit(2)))
    # the half without rows is done as well
    assert [tuple(r) for r in asked] == [("b", 1)] and seen(spark, root) == [("a", 1, 1), ("b", 1, 2)]
    manifest.run_stage(work, root, "velocity", lost)
    assert manifest.unfinished(work, root, "labels").count() == 3 and seen(spark, root, "labels") == []


def test_a_new_version_replaces_whole_halves(spark, tmp_path):
    root = str(tmp_path)
    for value in (1, 2):
        rows = spark.createDataFrame([("a", 1, value), ("a", 1, value + 10), ("b", 1, value)], "match string, half int, v int")
        rows = rows.where("match = 'a' or v = 1").where(f"{value} = 1 or v < 10")
        manifest.publish(rows, root, "labels", manifest.write_version(rows, root, "labels"))
    assert seen(spark, root, "labels") == [("a", 1, 2), ("b", 1, 1)]
