"""Hand-made cases of the frame, flow and class operators."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchgrid.functions import geometry as G
from pitchgrid.functions import vectors as V
from pitchgrid.operators import aggregation, matching, ranking, selection

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def boxes(spark, rows, index):
    return spark.createDataFrame([(f, i, tuple(map(float, b))) for f, i, b in rows], f"f int, {index} int, {index}box {BOX}")


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_match_cases(spark):
    left = boxes(spark, [(1, 0, (0, 0, 9, 9)), (1, 1, (1, 0, 10, 9)), (2, 0, (0, 0, 9, 9)), (3, 0, (0, 0, 9, 9)), (4, 0, (0, 0, 9, 9)), (5, 0, (0, 0, 9, 0))], "l")
    right = boxes(spark, [(1, 0, (0, 0, 9, 9)), (1, 1, (50, 50, 60, 60)), (1, 2, (80, 80, 90, 90)), (2, 4, (0, 0, 9, 9)), (2, 3, (0, 0, 9, 9)), (4, 0, (90, 90, 99, 99)), (5, 0, (9, 0, 9, 0))], "r")
    got = {(r.f, r.l, r.r) for r in matching.iou_match(left, right, ["f"]).collect()}
    # frame 1: two boxes share a best segment; 2: the lowest index among ties; 3: no segments; 4: no overlap; 5: exactly 0.1
    assert got == {(1, 0, 0), (1, 1, 0), (2, 0, 3)}
    flipped = {(r.f, r.l, r.r) for r in matching.iou_match(right.toDF("f", "l", "lbox"), left.toDF("f", "r", "rbox"), ["f"]).collect()}
    assert {(f, b, a) for f, a, b in flipped} == got


def test_mean_iou_sentinels(spark):
    left = boxes(spark, [(1, 0, (0, 0, 9, 9)), (2, 0, (0, 0, 9, 9))], "l")
    right = boxes(spark, [(1, 0, (0, 0, 9, 9)), (3, 0, (0, 0, 9, 9))], "r")
    spine = spark.createDataFrame([(1,), (2,), (3,)], "f int")
    assert dict(tuple(r) for r in matching.mean_iou(spine, left, right, ["f"]).collect()) == {1: 1.0, 2: -1.0, 3: 3.0}


def test_frame_filter_quantifier_and_thresholds(spark):
    small, large = (0.0, 0.0, 9.0, 9.0), (0.0, 0.0, 99.0, 99.0)
    rows = [(1, small, True), (1, large, False), (2, small, True), (2, large, True), (3, small, True), (4, small, False)]
    d = spark.createDataFrame(rows, f"f int, bbox {BOX}, onfield boolean")
    c = spark.createDataFrame([(1, 0.75), (2, 0.9), (3, 0.74), (4, 0.9)], "f int, confidence double")
    assert [r.f for r in selection.small_players(d, c, ["f"], 0.75, 100).collect()] == [1]


def test_goal_distance_is_strict_and_touchline_can_be_off(spark):
    people = spark.createDataFrame([(1, 5.0, 3.0), (2, 4.9, 10.0), (2, 50.0, 10.0)], "f int, goal_dist double, radar_y double")
    assert [r.f for r in selection.far_from_goals(people, ["f"], 5.0).collect()] == [1]
    assert selection.touchline_band(people, 3.0, 29.0).count() == 2 and selection.touchline_band(people, 0, 29.0).count() == 3


def test_isolation_and_last_writer(spark):
    people = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0), (2, 1, 2.4, 0.0), (3, 0, 0.0, 0.0), (3, 1, 2.5, 0.0)], "f int, idx int, x double, y double")
    assert sorted(r.f for r in matching.isolated(people.where("idx = 0"), people, ["f"], 2.5).collect()) == [1, 3]
    rows = spark.createDataFrame([(1, 3), (1, 4), (2, 3)], "f int, category int")
    assert sorted(tuple(r) for r in ranking.last_writer(rows, ["f"], "category").collect()) == [(1, 4), (2, 3)]


@pytest.mark.parametrize("n,want", [(1, 0), (5, 1), (15, 2), (25, 2), (30, 3)])
def test_split_sizes_round_half_to_even(spark, n, want):
    rows = spark.range(n).withColumn("category", F.lit(1))
    assert ranking.stratified_split(rows, "category", "id", 0.1).where("split = 'valid'").count() == want


def test_contiguous_parts_without_exchange_reuse(spark):
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = ranking.contiguous_parts(spark.range(50_000).selectExpr("id * 7919 % 50000 as id").repartition(16), "id", 5).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert [r.part for r in got] == [1 + i // 10_000 for i in range(50_000)]


def test_contiguous_parts(spark):
    got = ranking.contiguous_parts(spark.range(23), "id", 4).orderBy("id").collect()
    assert [r.part for r in got] == [1] * 6 + [2] * 6 + [3] * 6 + [4] * 5
    assert [r.part for r in ranking.contiguous_parts(spark.range(2), "id", 4).orderBy("id").collect()] == [1, 2]
    assert ranking.contiguous_parts(spark.range(0), "id", 4).count() == 0


def test_homography_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(20):
        h = np.eye(3) + rng.normal(0, 0.2, (3, 3)) * [[1, 1, 9], [1, 1, 9], [0.01, 0.01, 0]]
        rows.append((h.ravel().tolist(), *rng.uniform(0, 50, 2).tolist()))
    df = spark.createDataFrame(rows, "h array<double>, x double, y double")
    x, y = G.unproject(F.col("h"), F.col("x"), F.col("y"))
    for r in df.select("*", x.alias("px"), y.alias("py")).collect():
        p = np.linalg.inv(np.reshape(r.h, (3, 3))) @ [r.x, r.y, 1]
        assert np.allclose([r.px, r.py], p[:2] / p[2])


def test_orientation_against_numpy(spark):
    rng = np.random.default_rng(1)
    for _ in range(5):
        uv = np.clip(rng.normal(0.2, 0.3, (40, 2)) * [1, 0.3], -1, 1)
        rows = spark.createDataFrame([(1, *v) for v in uv.tolist()], "g int, u double, v double")
        r = aggregation.dominant_orientation(rows, ["g"]).first()
        m = uv.T @ uv
        values, vectors = np.linalg.eigh(m)
        up = [np.histogram(uv[:, k], bins=[-1, 0, 1])[0] for k in (0, 1)]
        sign = np.array([1 if b > a else -1 for a, b in up])
        assert np.allclose([r.vx, r.vy], np.trace(m) / 40 * sign * np.abs(vectors[:, 1]))


def test_orientation_of_still_and_out_of_range_flow(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, -1.0000078, 0.5)], "g int, u double, v double")
    got = {r.g: r for r in aggregation.second_moments(rows, ["g"]).collect()}
    assert (got[2].u_up, got[2].u_down) == (0, 0)
    assert {r.g: (r.vx, r.vy) for r in aggregation.dominant_orientation(rows, ["g"]).collect()}[1] == (0.0, 0.0)


def test_vector_expressions(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    d, same, empty = one(spark, V.bhattacharyya(a(1, 0), a(0, 1)), V.bhattacharyya(a(0.5, 0.5), a(0.5, 0.5)), V.bhattacharyya(a(0, 0), a(1, 0)))
    assert (d, empty) == (1.0, None) and abs(same) < 1e-7
    area, none = one(spark, V.triangle_area(F.lit(3.0), F.lit(4.0), F.lit(5.0)), V.triangle_area(F.lit(1.0), F.lit(1.0), F.lit(5.0)))
    assert (area, none) == (6.0, None)
    assert one(spark, V.argmax(a(1, 5, 5))) == (1,)


def test_index_grids_against_numpy(spark):
    for n, r in ((9, 5), (100, 7), (5, 9)):
        got = [x[0] for x in spark.range(r).select(ranking.flow_index(F.col("id"), F.lit(n), F.lit(r))).collect()]
        assert got == (np.ceil(np.round(np.linspace(n / r, n, r), 9)).astype(int) - 1).tolist()
    got = [x[0] for x in spark.range(4).select(ranking.sampling_index(F.col("id"), F.lit(11), 4)).collect()]
    assert got == [0, 4, 7, 10]


def test_class_fallback_and_triplets(spark):
    members = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [0.5, 0.5])]
    df = spark.createDataFrame(members, "category int, hist array<double>")
    kept = selection.class_filter_with_fallback(df, aggregation.class_medians(df), [3, 4], 0, 0.4)
    assert sorted(r.category for r in kept.collect()) == [0, 0, 3, 3, 4]
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "k int, hist array<double>")
    assert ranking.farthest_triplet(ranking.pair_distances(two)).count() == 0


def test_row_order_does_not_matter(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(F.col("l_orderkey").alias("f"), F.monotonically_increasing_id().cast("int").alias("l"), G.box(F.col("l_partkey") % 9, F.lit(0), F.col("l_partkey") % 9 + 10, F.lit(9)).alias("lbox")).limit(800)
    rows = d.collect()
    left = spark.createDataFrame(rows, d.schema)
    right = left.toDF("f", "r", "rbox")
    want = sorted(tuple(r) for r in matching.iou_match(left, right, ["f"]).collect())
    shuffled = spark.createDataFrame(rows[::-1], d.schema)
    assert sorted(tuple(r) for r in matching.iou_match(shuffled, shuffled.toDF("f", "r", "rbox"), ["f"]).collect()) == want


def test_frames_are_dealt_once_and_tasks_follow_the_lines(spark, monkeypatch):
    """A frame's rows are sorted by one exchange for the window and the join, over more tasks where there are more lines."""
    from pitchgrid import adapters
    from pitchgrid.plans import queries

    few = queries.frame_override_union(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(adapters, "LINES_PER_TASK", 500)
    out = queries.frame_override_union(spark, "/root/testdata/sf0.001")
    n = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500)
    assert n > 4 and "RepartitionByExpression [frame_idx" in out._jdf.queryExecution().optimizedPlan().toString()
    base = out._jdf.queryExecution().executedPlan().toString().split("LeftAnti")[1].split("Window")[0]
    assert "Exchange" not in base and "Sort [" not in base
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, few))
