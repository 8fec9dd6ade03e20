"""Labelled folders and their training copies."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchgrid.functions import augment
from pitchgrid.functions.augment import DRAWS, Recipe
from pitchgrid.functions.pictures import png
from pitchgrid.sources import labelled_pictures as L

SMALL = Recipe(resized=12, cropped=9)


def picture(seed, height=14, width=18, grey=False):
    shape = (height, width) if grey else (height, width, 3)
    return np.random.default_rng(seed).integers(0, 256, shape, np.uint8)


@pytest.fixture()
def root(spark, tmp_path):
    rows = [(label, f"{i:02}.png", png(picture(i, 14 + i, 18, i == 3))) for label in ("b-team", "a team", "c") for i in range(5)]
    assert L.write_labelled(spark.createDataFrame(rows, "label string, name string, data binary"), str(tmp_path)) == 15
    (tmp_path / "c" / "notes.txt").write_text("no picture")
    return str(tmp_path)


def test_classes_are_folders_in_the_order_of_names(spark, root):
    got = {(r.label, r.category) for r in L.list_labelled(spark, root).collect()}
    assert got == {("a team", 0), ("b-team", 1), ("c", 2)}
    given = L.list_labelled(spark, root, ["none", "c"]).collect()
    assert len(given) == 5 and {(r.label, r.category) for r in given} == {("c", 1)}


def test_copies_are_the_same_in_any_partitioning_and_any_selection(spark, root):
    listing = L.list_labelled(spark, root)
    digest = F.sha2("pixels", 256).alias("d")
    made = lambda rows, **k: {(r.label, r.name, r.copy): r.d for r in L.training_pictures(rows, seed=5, recipe=SMALL, **k).select("label", "name", "copy", digest).collect()}
    whole = made(listing.coalesce(1), copies=4)
    assert len(whole) == 60 and made(listing.repartition(7), copies=4) == whole
    assert made(listing.where("label = 'c'").repartition(2), copies=2, first=2) == {k: v for k, v in whole.items() if k[0] == "c" and k[2] >= 2}
    other = {(r.label, r.name, r.copy): r.d for r in L.training_pictures(listing, 4, 6, SMALL).select("label", "name", "copy", digest).collect()}
    assert sum(other[k] != whole[k] for k in whole) > 50


def test_a_copy_is_the_chain_applied_with_the_digest_of_its_key(spark, root):
    for r in L.training_pictures(L.list_labelled(spark, root), 3, 5, SMALL).where("label = 'a team'").collect():
        h = hashlib.sha256(f"5/a team/{r.name}/{r.copy}".encode()).hexdigest()
        drawn = [int(h[8 * i : 8 * i + 8], 16) for i in range(5)]
        i = int(r.name[:2])
        want = augment.training_picture(augment.coloured(picture(i, 14 + i, 18, i == 3)), drawn, SMALL)
        assert (r.height, r.width) == (9, 9) and r.pixels == want.tobytes()


def test_batches_of_pixels_are_bounded(spark, root, monkeypatch):
    monkeypatch.setattr(L, "BATCH_BYTES", 1)
    listing = L.list_labelled(spark, root)
    assert L.training_pictures(listing, 2, 1, SMALL).count() == 30
    assert {(r.height, r.width, len(r.pixels)) for r in L.evaluation_pictures(listing, 8).collect()} == {(8, 8, 192)}


def test_pictures_are_spread_over_tasks(spark, root, monkeypatch):
    monkeypatch.setattr(L, "TASK_PICTURES", 6)
    made = L.training_pictures(L.list_labelled(spark, root), 2, 1, SMALL)
    assert made.rdd.getNumPartitions() == 5
    homes = made.select("label", "name", F.spark_partition_id().alias("t"))
    assert homes.groupBy("label", "name").agg(F.countDistinct("t").alias("n")).where("n > 1").count() == 0  # copies share a task


def test_empty_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    listing = L.list_labelled(spark, str(tmp_path))
    assert listing.count() == 0 and L.training_pictures(listing, 1, 1).count() == 0


def test_no_pixels_in_an_exchange(spark, root):
    plan = L.training_pictures(L.list_labelled(spark, root), 1, 1, SMALL)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in above


def test_resize_weights_and_shapes():
    for source, target in ((8, 6), (6, 8), (1, 5), (5, 1), (300, 256), (720, 224)):
        w = augment.resize_weights(source, target)
        assert w.shape == (target, source) and (w.sum(axis=1) == augment.ONE).all() and (w >= 0).all()
    flat = np.full((7, 9, 3), 77, np.uint8)
    assert (augment.resized(flat, 5, 20) == 77).all()
    assert augment.shorter_side(picture(1, 10, 25), 4).shape == (4, 10, 3)
    assert augment.shorter_side(picture(1, 25, 10), 4).shape == (10, 4, 3)
    assert (augment.resized(picture(2), 14, 18) == picture(2)).all()
    half = augment.resized(picture(4, 16, 16), 8, 8).astype(int)
    boxes = picture(4, 16, 16).reshape(8, 2, 8, 2, 3).mean(axis=(1, 3))
    assert np.abs(half - boxes).mean() < 25


def test_each_draw_decides_one_change():
    image, never = picture(3, 12, 12), DRAWS - 1
    plain = augment.training_picture(image, [0, 0, never, never, never], SMALL)
    assert (plain == image[:9, :9]).all()
    assert (augment.training_picture(image, [never, never, never, never, never], SMALL) == image[3:, 3:]).all()
    assert (augment.training_picture(image, [0, 0, 0, never, never], SMALL) == plain[:, ::-1]).all()
    strong = augment.training_picture(image // 2 + 9, [0, 0, never, 0, never], SMALL)
    assert (strong.min(axis=(0, 1)) == 0).all() and (strong.max(axis=(0, 1)) == 255).all()
    grey = augment.training_picture(image, [0, 0, never, never, 0], SMALL)
    assert (grey == grey[..., :1]).all()
    assert (augment.stretched(np.full((2, 2, 3), 9, np.uint8)) == 9).all()
    with pytest.raises(ValueError):
        Recipe(resized=5, cropped=6)
    with pytest.raises(ValueError):
        Recipe(flip=2)
