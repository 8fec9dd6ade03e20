"""Registered queries of the video-analytics operators and their DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchgrid import adapters as A
from pitchgrid.adapters import bhattacharyya_sql, table, with_sql
from pitchgrid.functions import geometry as G
from pitchgrid.functions import vectors as V
from pitchgrid.operators import aggregation, matching, ranking, selection
from pitchgrid.plans.config import TrainingConfig
from pitchgrid.plans.registry import ORACLES, QUERIES, query
from pitchgrid.sources.shared import checkpointed, new_path

def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = A.detections(spark, d).select("frame_idx", F.col("det_idx").alias("l"), F.col("bbox").alias("lbox"))
    right = A.segmentation(spark, d).select("frame_idx", F.col("seg_idx").alias("r"), F.col("bbox").alias("rbox"))
    return left, right


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_idx"))


# correspondence of boxes


@query(with_sql("det", "seg", "best") + "SELECT frame_idx, l AS det_idx, r AS seg_idx, round(iou, 6) AS iou FROM best WHERE iou > 0.1E0")
def iou_match(spark, d):
    left, right = _sides(spark, d)
    m = matching.iou_match(left, right, ["frame_idx"])
    return m.select("frame_idx", F.col("l").alias("det_idx"), F.col("r").alias("seg_idx"), F.round("iou", 6).alias("iou"))


@query(
    with_sql("det", "seg", "best")
    + """SELECT o_orderkey AS frame_idx, round(CASE WHEN n IS NULL THEN 3E0 ELSE coalesce(m, -1E0) END, 6) AS mean_iou FROM orders
    LEFT JOIN (SELECT frame_idx, count(*) AS n FROM det GROUP BY 1) d ON d.frame_idx = o_orderkey
    LEFT JOIN (SELECT frame_idx, avg(iou) AS m FROM best GROUP BY 1) b ON b.frame_idx = o_orderkey"""
)
def mean_iou_per_frame(spark, d):
    return matching.mean_iou(_frames(spark, d), *_sides(spark, d), ["frame_idx"]).select("frame_idx", F.round("mean_iou", 6).alias("mean_iou"))


@query(
    with_sql("det", "seg", "best")
    + """SELECT frame_idx, count(*) FILTER (iou > 0.3E0) AS matched, round(count(*) FILTER (iou > 0.3E0) / least(n_left, n_right)::DOUBLE, 6) AS ratio
    FROM best GROUP BY frame_idx, n_left, n_right HAVING count(*) FILTER (iou > 0.3E0) / least(n_left, n_right)::DOUBLE < 0.8E0"""
)
def suspicious_frames(spark, d):
    return matching.suspicious_frames(*_sides(spark, d), ["frame_idx"]).withColumn("ratio", F.round("ratio", 6))


@query(
    with_sql("det", "seg", "flow", "moments")
    + """, p AS (SELECT frame_idx, row_number() OVER (PARTITION BY frame_idx ORDER BY seg_idx) - 1 AS person_idx, score, x1, y1, x2, y2 FROM seg WHERE class_id = 0)
    SELECT o_orderkey AS frame_idx, p.person_idx, p.score, x1, y1, x2, y2, round(vx, 6) AS vx, round(vy, 6) AS vy, logits[1] AS first_logit
    FROM orders LEFT JOIN p ON p.frame_idx = o_orderkey
    LEFT JOIN (SELECT person AS f, frame AS i, vx, vy FROM orient) v ON v.f = o_orderkey AND v.i = p.person_idx
    LEFT JOIN (SELECT vec_id AS f, label AS i, embedding[1:5]::DOUBLE[] AS logits FROM embeddings) t ON t.f = o_orderkey AND t.i = p.person_idx"""
)
def result_join(spark, d):
    people = matching.person_index(A.segmentation(spark, d), ["frame_idx"], "seg_idx").select("frame_idx", "person_idx", "score", "bbox.*")
    motion = aggregation.dominant_orientation(A.flow(spark, d), ["frame", "person"])
    velocity = motion.select(F.col("person").alias("frame_idx"), F.col("frame").alias("person_idx"), F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))
    teams = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("frame_idx"), F.col("label").alias("person_idx"), F.get("embedding", F.lit(0)).cast("double").alias("first_logit")
    )
    return matching.result_join(_frames(spark, d), people, velocity, teams, ["frame_idx"])


@query(with_sql("det", "seg") + "SELECT frame_idx, seg_idx, row_number() OVER (PARTITION BY frame_idx ORDER BY seg_idx) - 1 AS person_idx FROM seg WHERE class_id = 0 AND score > 0.65E0")
def person_spine(spark, d):
    people = A.segmentation(spark, d).where(F.col("score") > 0.65)
    return matching.person_index(people, ["frame_idx"], "seg_idx").select("frame_idx", "seg_idx", F.col("person_idx").cast("bigint").alias("person_idx"))


_NEAR_KEEPERS = """, k AS (SELECT * FROM foot QUALIFY row_number() OVER (PARTITION BY frame ORDER BY goal_dist, idx) = 1),
  k2 AS (SELECT * FROM k WHERE goal_dist <= 20)"""


@query(
    with_sql("cal", "foot")
    + _NEAR_KEEPERS
    + """ SELECT frame, idx, round(goal_dist, 6) AS goal_dist FROM k2 WHERE NOT EXISTS (SELECT 1 FROM foot o WHERE o.frame = k2.frame AND o.idx <> k2.idx
      AND sqrt((o.radar_x - k2.radar_x) * (o.radar_x - k2.radar_x) + (o.radar_y - k2.radar_y) * (o.radar_y - k2.radar_y)) < 2.5E0)"""
)
def goalkeeper_isolation(spark, d):
    people = A.foot_points(spark, d)
    named = people.withColumns({"x": F.col("radar_x"), "y": F.col("radar_y")})
    keepers = selection.nearest_to_goal(named, ["frame"], 20.0)
    return matching.isolated(keepers, named, ["frame"], 2.5).select("frame", "idx", F.round("goal_dist", 6).alias("goal_dist"))


# frame and person filters


@query(
    with_sql("det", "cal")
    + """, k AS (SELECT det.* FROM det WHERE onfield AND frame_idx IN (SELECT frame_idx FROM cal WHERE confidence >= 0.25E0))
    SELECT frame_idx, det_idx, x1, y1, x2, y2 FROM k WHERE frame_idx IN (SELECT frame_idx FROM k GROUP BY 1 HAVING max((x2 - x1 + 1) * (y2 - y1 + 1)) <= 7600)"""
)
def frame_forall_filter(spark, d):
    kept = selection.small_players(A.detections(spark, d), A.calibration(spark, d), ["frame_idx"], 0.25, 7600)
    return kept.select("frame_idx", "det_idx", "bbox.*")


@query(
    with_sql("det", "cal")
    + """, k AS (SELECT det.* FROM det WHERE onfield AND frame_idx IN (SELECT frame_idx FROM cal WHERE confidence >= 0.25E0))
    SELECT frame_idx, count(*) AS n FROM k GROUP BY 1 HAVING max((x2 - x1 + 1) * (y2 - y1 + 1)) <= 8000 AND count(*) >= 4"""
)
def frame_min_boxes_filter(spark, d):
    kept = selection.small_players(A.detections(spark, d), A.calibration(spark, d), ["frame_idx"], 0.25, 8000, 4)
    return kept.groupBy("frame_idx").agg(F.count("*").alias("n"))


@query(with_sql("cal", "foot") + "SELECT frame, idx, round(radar_x, 6) AS radar_x, round(radar_y, 6) AS radar_y, round(goal_dist, 6) AS goal_dist FROM foot")
def radar_position(spark, d):
    return A.foot_points(spark, d).select("frame", "idx", *[F.round(c, 6).alias(c) for c in ("radar_x", "radar_y", "goal_dist")])


@query(with_sql("cal", "foot") + "SELECT frame, idx FROM foot WHERE frame NOT IN (SELECT frame FROM foot WHERE goal_dist < 3E0)")
def goal_distance_filter(spark, d):
    return selection.far_from_goals(A.foot_points(spark, d), ["frame"], 3.0).select("frame", "idx")


@query(with_sql("cal", "foot") + "SELECT frame, idx FROM foot WHERE radar_y > 3 AND radar_y < 29")
def touchline_band(spark, d):
    return selection.touchline_band(A.foot_points(spark, d), 3.0, 29.0).select("frame", "idx")


@query(with_sql("det") + "SELECT frame_idx, det_idx, (x2 - x1 + 1) * (y2 - y1 + 1) AS area, floor((x1 + x2) / 2)::BIGINT AS cx, floor((y1 + y2) / 2)::BIGINT AS cy FROM det WHERE (x2 - x1 + 1) * (y2 - y1 + 1) >= 5000")
def min_area_filter(spark, d):
    b = F.col("bbox")
    centre = [F.floor((b[f"{a}1"] + b[f"{a}2"]) / 2).alias(f"c{a}") for a in "xy"]
    return A.detections(spark, d).select("frame_idx", "det_idx", G.area(b).alias("area"), *centre).where("area >= 5000")


@query(
    with_sql("det")
    + """, r AS (SELECT *, CASE s % 3 WHEN 0 THEN '4:3' WHEN 1 THEN '1:1' ELSE '3:4' END AS sar FROM det),
    v AS (SELECT *, split_part(sar, ':', 1)::DOUBLE / split_part(sar, ':', 2)::DOUBLE AS ratio FROM r)
    SELECT frame_idx, det_idx, sar, round(ratio, 6) AS ratio, trunc(CASE WHEN ratio > 1 THEN x1 * ratio ELSE x1 END)::INT AS x1, trunc(CASE WHEN ratio > 1 THEN x2 * ratio ELSE x2 END)::INT AS x2 FROM v"""
)
def sar_scaled_boxes(spark, d):
    from pitchgrid.sources.readers import ratio

    sar = F.when(F.col("s") % 3 == 0, "4:3").when(F.col("s") % 3 == 1, "1:1").otherwise("3:4")
    rows = A.detections(spark, d).withColumn("sar", sar).withColumn("ratio", ratio(F.col("sar")))
    x = {c: G.scaled_x(F.col("bbox")[c], F.col("ratio")).cast("int").alias(c) for c in ("x1", "x2")}
    return rows.select("frame_idx", "det_idx", "sar", F.round("ratio", 6).alias("ratio"), *x.values())


@query(
    with_sql("det")
    + """SELECT frame_idx, det_idx, trunc(x1 * 0.7E0)::INT AS x1, trunc(y1 * 0.4E0)::INT AS y1, trunc(x2 * 0.7E0)::INT AS x2, trunc(y2 * 0.4E0)::INT AS y2,
    trunc(10 * ((trunc(x2 * 0.7E0) - trunc(x1 * 0.7E0)) / (x2 - x1)))::INT AS px, trunc(20 * ((trunc(y2 * 0.4E0) - trunc(y1 * 0.4E0)) / (y2 - y1)))::INT AS py FROM det"""
)
def scale_masks(spark, d):
    mask = F.array(F.array(F.struct(F.lit(10).alias("x"), F.lit(20).alias("y"))))
    rows = A.detections(spark, d).withColumn("to", G.truncated_box(F.col("bbox"), F.lit(0.7), F.lit(0.4)))
    point = G.scaled_polygons(mask, F.col("bbox"), F.col("to"))[0][0]
    return rows.select("frame_idx", "det_idx", "to.*", point["x"].alias("px"), point["y"].alias("py"))


@query(
    with_sql("det")
    + """, e AS (SELECT frame_idx, det_idx, x1 + 20 AS x, y1 + 30 AS y, x1 AS ax, y1 AS ay, x2 AS bx, y1 + p % 40 AS by_, x1 + p % 25 AS cx, y2 AS cy FROM det),
    c AS (SELECT frame_idx, det_idx,
      ((ay > y) <> (by_ > y) AND coalesce(x < ax + (y - ay) * (bx - ax) / nullif(by_ - ay, 0), false))::INT + ((by_ > y) <> (cy > y) AND coalesce(x < bx + (y - by_) * (cx - bx) / nullif(cy - by_, 0), false))::INT
      + ((cy > y) <> (ay > y) AND coalesce(x < cx + (y - cy) * (ax - cx) / nullif(ay - cy, 0), false))::INT AS n FROM e)
    SELECT frame_idx, det_idx, n % 2 = 1 AS inside FROM c"""
)
def point_in_contour(spark, d):
    b, p = F.col("bbox"), F.col("p")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    polygon = F.array(corner(b["x1"], b["y1"]), corner(b["x2"], b["y1"] + p % 40), corner(b["x1"] + p % 25, b["y2"]))
    return A.detections(spark, d).select("frame_idx", "det_idx", selection.inside_polygon(b["x1"] + 20, b["y1"] + 30, polygon).alias("inside"))


@query("SELECT o_orderkey AS match FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_antijoin(spark, d):
    from pitchgrid.sources.worklist import pending

    work = table(spark, d, "orders").select(F.col("o_orderkey").alias("match"))
    return pending(work, table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("match")), ["match"])


# flow


@query(with_sql("flow", "moments") + "SELECT frame, person, round(vx, 6) AS vx, round(vy, 6) AS vy FROM orient")
def dominant_orientation(spark, d):
    return aggregation.dominant_orientation(A.flow(spark, d), ["frame", "person"]).select("frame", "person", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


_FIELD = """, fm AS (
  SELECT frame, sum(u*u) AS suu, sum(v*v) AS svv, sum(u*v) AS suv, count(*) AS n, count(*) FILTER (u >= 0 AND u <= 1) AS uu, count(*) FILTER (u >= -1 AND u < 0) AS ud,
    count(*) FILTER (v >= 0 AND v <= 1) AS vu, count(*) FILTER (v >= -1 AND v < 0) AS vd FROM flow WHERE pos < 8 GROUP BY ALL),
fv AS (SELECT frame, (suu + svv) / n * CASE WHEN uu > ud THEN 1 ELSE -1 END * abs(cos(0.5E0 * atan2(2 * suv, suu - svv))) AS fx,
  (suu + svv) / n * CASE WHEN vu > vd THEN 1 ELSE -1 END * abs(sin(0.5E0 * atan2(2 * suv, suu - svv))) AS fy FROM fm)"""


@query(with_sql("flow", "moments") + _FIELD + "SELECT frame, person, round(vx - coalesce(fx, 0), 6) AS vx, round(vy - coalesce(fy, 0), 6) AS vy FROM orient LEFT JOIN fv USING (frame)")
def player_minus_field_velocity(spark, d):
    from pitchgrid.operators.motion import relative_velocity

    flow = A.flow(spark, d)
    v = relative_velocity(flow, flow.where("pos < 8"), ["frame"], "person")
    return v.select("frame", "person", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


@query("SELECT o_orderkey AS k, CAST(ceil(25000 * (o_orderkey + 1) / (200000::DOUBLE)) AS BIGINT) - 1 AS flow_idx FROM orders")
def flow_index_grid(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), ranking.flow_index(F.col("o_orderkey"), F.lit(25000), F.lit(200000)).alias("flow_idx"))


@query("SELECT o_orderkey AS k, CAST(trunc(o_orderkey * 3199 / 199999::DOUBLE) AS INT) AS flow_idx FROM orders")
def repaired_index_map(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), ranking.repaired_flow_index(F.col("o_orderkey"), F.lit(3200), F.lit(200000)).alias("flow_idx"))


@query(
    """WITH n AS (SELECT max(o_orderkey) + 1 AS n FROM orders), g AS (SELECT k, CAST(ceil(k * (n - 1) / 539::DOUBLE) AS BIGINT) AS frame_idx FROM range(540) r(k), n)
    SELECT k, frame_idx, o_custkey FROM g JOIN orders ON o_orderkey = frame_idx"""
)
def sampling_grid(spark, d):
    """540 frames spread evenly over all, whose number is that of the last order."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_idx"), "o_custkey")
    frames = orders.agg((F.max("frame_idx") + 1).alias("n"))
    grid = spark.range(540).crossJoin(F.broadcast(frames)).select(F.col("id").alias("k"), ranking.sampling_index(F.col("id"), F.col("n"), 540).alias("frame_idx"))
    return F.broadcast(grid).join(orders, "frame_idx").select("k", "frame_idx", "o_custkey")  # 540 rows


@query(with_sql("det") + "SELECT frame_idx, det_idx, CAST(ceil(5400 * (q + 1) / 51::DOUBLE) AS BIGINT) - 1 AS flow_idx, vec_id FROM det JOIN embeddings ON vec_id = CAST(ceil(5400 * (q + 1) / 51::DOUBLE) AS BIGINT) - 1")
def flow_gather(spark, d):
    rows = A.detections(spark, d).select("frame_idx", "det_idx", ranking.flow_index(F.col("q"), F.lit(5400), F.lit(51)).alias("flow_idx"))
    return rows.join(table(spark, d, "embeddings").select("vec_id"), F.col("flow_idx") == F.col("vec_id"))


@query(
    """WITH c(height, rh, rw, bh, bw, fh, fw) AS (VALUES (480, 390, 693, 3E0, 26.5E0, 256, 426), (576, 468, 832, 10E0, 0E0, 256, 475), (720, 585, 1040, 8E0, 4.5E0, 256, 455),
      (768, 624, 1109, 24E0, 10.5E0, 256, 483), (1080, 877, 1560, 22.5E0, 12E0, 256, 472)),
    b AS (SELECT *, bh * fh / trunc(rh - 2 * bh) AS y, bw * fw / trunc(rw - 2 * bw) AS x FROM c)
    SELECT height, fh AS flow_height, fw AS flow_width, ceil(y)::INT AS top, floor(y)::INT AS bottom, ceil(x)::INT AS "left", floor(x)::INT AS "right",
      (fh + ceil(y) + floor(y))::INT AS full_height, (fw + ceil(x) + floor(x))::INT AS full_width FROM b"""
)
def flow_geometry(spark, d):
    from pitchgrid.operators.motion import flow_geometry as geometry

    return geometry(spark)


@query(
    """SELECT label AS frame, k AS pos, round(least(avg(abs(embedding[k + 1]::DOUBLE)), 0.1E0), 6) AS mean
    FROM embeddings, unnest(range(0, len(embedding))) AS r(k) GROUP BY ALL"""
)
def temporal_mean_flow(spark, d):
    frames = table(spark, d, "embeddings").select(F.col("label").alias("frame"), F.col("embedding").alias("values"))
    return aggregation.temporal_mean(frames, ["frame"], cap=0.1).withColumn("mean", F.round("mean", 6))


@query("SELECT vec_id, (SELECT round(sum(x::DOUBLE * x::DOUBLE) / 2, 6) FROM unnest(embedding[1:2]) t(x)) AS energy, (SELECT sum(x::DOUBLE * x::DOUBLE) / 2 FROM unnest(embedding[1:2]) t(x)) < 0.01E0 AS is_static FROM embeddings")
def static_clusters(spark, d):
    c = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", (V.total(c) / 2).alias("e")).select("vec_id", F.round("e", 6).alias("energy"), (F.col("e") < 0.01).alias("is_static"))


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) / (len(a.embedding) * 65025E0), 12) AS mse FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def patch_similarity(spark, d):
    e = table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.squared_error(F.col("embedding"), F.col("b"), 65025.0), 12).alias("mse"))


# histograms and classes


@query(with_sql("hist") + "SELECT event_type, bin, round(sum(n) / sum(sum(n)) OVER (PARTITION BY event_type)::DOUBLE, 6) AS share FROM bins GROUP BY event_type, bin")
def color_histogram(spark, d):
    return aggregation.histogram(table(spark, d, "events"), ["event_type"], "value", 8, 0.0, 500.0).withColumn("share", F.round("share", 6))


@query(with_sql("hist", "members", "med") + "SELECT category, k - 1 AS pos, round(m, 6) AS m FROM medpos")
def class_median_vector(spark, d):
    return aggregation.class_medians(A.members(spark, d)).select("category", F.posexplode("median").alias("pos", "m")).withColumns({"m": F.round("m", 6), "pos": F.col("pos").cast("bigint")})


@query(with_sql("hist", "members", "med") + f"SELECT category, id FROM members JOIN med USING (category) WHERE {bhattacharyya_sql('hist', 'median')} <= 0.2E0")
def filter_by_class_median(spark, d):
    m = A.members(spark, d)
    return selection.near_class_median(m, aggregation.class_medians(m), 0.2).select("category", "id")


@query(
    with_sql("hist", "members", "med")
    + f", r AS (SELECT median AS ref FROM med WHERE category = 0) SELECT category, id FROM members CROSS JOIN r WHERE NOT (category IN (3, 4) AND coalesce({bhattacharyya_sql('hist', 'ref')} <= 0.2E0, false))"
)
def goalkeeper_referee_filter(spark, d):
    m = A.members(spark, d)
    return selection.unlike_class(m, aggregation.class_medians(m), [3, 4], 0, 0.2).select("category", "id")


@query(with_sql("hist", "members", "med") + f"SELECT category, id FROM members JOIN med USING (category) WHERE {bhattacharyya_sql('hist', 'median')} <= 0.25E0")
def class_filter_fallback(spark, d):
    m = A.members(spark, d)
    return selection.class_filter_with_fallback(m, aggregation.class_medians(m), [3, 4], 0, 0.25).select("category", "id")


_PAIRS = f", dist AS (SELECT a.category AS a, b.category AS b, {bhattacharyya_sql('a.median', 'b.median')} AS d FROM med a JOIN med b ON a.category < b.category)"


def _class_pairs(spark, d):
    medians = aggregation.class_medians(A.members(spark, d))
    return ranking.pair_distances(medians.select(F.col("category").alias("k"), F.col("median").alias("hist")))


@query(with_sql("hist", "members", "med") + _PAIRS + "SELECT a, b, round(d, 6) AS distance FROM dist")
def bhattacharyya_matrix(spark, d):
    return _class_pairs(spark, d).withColumn("distance", F.round("distance", 6))


@query(
    with_sql("hist", "members", "med")
    + _PAIRS
    + """, t AS (SELECT x.a, x.b, z.b AS c, x.d AS p, y.d AS q, z.d AS r, (x.d + y.d + z.d) / 2 AS s FROM dist x JOIN dist y ON y.a = x.b JOIN dist z ON z.a = x.a AND z.b = y.b),
    h AS (SELECT a, b, c, CASE WHEN s*(s-p)*(s-q)*(s-r) >= 0 THEN sqrt(s*(s-p)*(s-q)*(s-r)) END AS area FROM t)
    SELECT a, b, c, round(area, 6) AS area FROM h WHERE area > 0 ORDER BY round(area, 9) DESC, a, b, c LIMIT 1"""
)
def farthest_triplet(spark, d):
    return ranking.farthest_triplet(_class_pairs(spark, d)).withColumn("area", F.round("area", 6))


@query(
    with_sql("hist", "members")
    + f""", half AS (SELECT *, id % 2 AS side FROM members WHERE category IN (1, 2)), hp AS (SELECT side, category, k, median(hist[k]) AS m FROM half, unnest(range(1, 9)) AS r(k) GROUP BY ALL),
    hm AS (SELECT side, category, list(m ORDER BY k) AS md FROM hp GROUP BY ALL)
    SELECT a.category AS dark, b.category AS bright, round({bhattacharyya_sql('a.md', 'b.md')}, 6) AS distance FROM hm a JOIN hm b ON a.side = 0 AND b.side = 1
    ORDER BY round({bhattacharyya_sql('a.md', 'b.md')}, 9), 1, 2 LIMIT 1"""
)
def dark_bright_pair(spark, d):
    m = A.members(spark, d)
    sides = [aggregation.class_medians(m.where(F.col("id") % 2 == s)) for s in (0, 1)]
    return ranking.closest_pairs(*sides, [1, 2]).withColumn("distance", F.round("distance", 6))


@query("WITH d(category) AS (VALUES (0), (1), (2), (3), (4), (11)) SELECT d.category, count(label) AS n FROM d LEFT JOIN embeddings e ON e.label = d.category GROUP BY 1")
def count_instances(spark, d):
    classes = spark.createDataFrame([(c,) for c in (0, 1, 2, 3, 4, 11)], "category int")
    return aggregation.count_instances(table(spark, d, "embeddings").select(F.col("label").alias("category")), classes)


@query("SELECT label AS category, count(*) AS n FROM embeddings GROUP BY 1")
def count_present(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("category")).agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT label AS old, count(*) AS n FROM embeddings GROUP BY 1), r AS (SELECT old, row_number() OVER (ORDER BY n, old) - 1 AS r FROM c)
    SELECT old, CASE WHEN r = 0 THEN 0 ELSE row_number() OVER (PARTITION BY r = 0 ORDER BY old) END::INT AS category FROM r"""
)
def referee_relabel(spark, d):
    return ranking.rarest_class_first(table(spark, d, "embeddings").select(F.col("label").alias("old")))


# ranks, splits and sets


@query("SELECT vec_id, list_position(embedding[1:5], list_max(embedding[1:5]))::INT - 1 AS team FROM embeddings")
def argmax_logits(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.argmax(F.slice("embedding", 1, 5)).alias("team"))


@query(
    """SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id)
      <= CASE WHEN count(*) OVER (PARTITION BY quality) > 1 THEN greatest(round_even(0.1E0 * count(*) OVER (PARTITION BY quality), 0), 1) ELSE 0 END THEN 'valid' ELSE 'train' END AS split FROM labels"""
)
def stratified_split(spark, d):
    return ranking.stratified_split(table(spark, d, "labels"), "quality", "doc_id", 0.1).select("doc_id", "quality", "split")


@query("SELECT doc_id, quality, lpad((row_number() OVER (PARTITION BY quality ORDER BY doc_id))::VARCHAR, 5, '0') || '.jpg' AS file_name FROM labels")
def split_numbering(spark, d):
    return ranking.number_within(table(spark, d, "labels"), ["quality"], ["doc_id"]).select("doc_id", "quality", "file_name")


@query("SELECT o_orderkey AS match, ntile(5) OVER (ORDER BY o_orderkey)::INT AS part FROM orders")
def ntile_worklist(spark, d):
    return ranking.contiguous_parts(table(spark, d, "orders").select(F.col("o_orderkey").alias("match")), "match", 5)


@query(
    with_sql("det")
    + """, o AS (SELECT frame_idx, det_idx + 1000 AS det_idx FROM det WHERE q > 40)
    SELECT frame_idx, det_idx FROM det WHERE frame_idx NOT IN (SELECT frame_idx FROM o) UNION ALL SELECT * FROM o"""
)
def frame_override_union(spark, d):
    base = A.detections(spark, d)
    other = base.where("q > 40").select("frame_idx", (F.col("det_idx") + 1000).alias("det_idx"))
    return ranking.override_frames(base.select("frame_idx", "det_idx"), other, ["frame_idx"])


@query(with_sql("det") + "SELECT frame_idx, det_idx, 3 + s % 2 AS category FROM det QUALIFY 3 + s % 2 = max(3 + s % 2) OVER (PARTITION BY frame_idx)")
def last_writer_wins(spark, d):
    rows = A.detections(spark, d).select("frame_idx", "det_idx", (3 + F.col("s") % 2).alias("category"))
    return ranking.last_writer(rows, ["frame_idx"], "category")


@query(with_sql("det") + "SELECT DISTINCT frame_idx FROM det WHERE q > 40 UNION SELECT frame_idx FROM det WHERE p % 7 = 0")
def frame_union(spark, d):
    base = A.detections(spark, d)
    return base.where("q > 40").select("frame_idx").union(base.where("p % 7 = 0").select("frame_idx")).distinct()


@query("SELECT quality AS truth, toxic AS guess, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality)::DOUBLE, 6) AS share FROM labels GROUP BY quality, toxic")
def confusion_matrix(spark, d):
    pairs = table(spark, d, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("guess"))
    return aggregation.confusion(pairs).withColumn("share", F.round("share", 6))


@query("SELECT round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels")
def accuracy(spark, d):
    return table(spark, d, "labels").agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 6).alias("accuracy"))


@query("SELECT event_id, round(sum(CAST(round(value * 100) AS BIGINT)) OVER w::DOUBLE / count(*) OVER w, 6) AS running_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_mean(spark, d):
    cents = table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return aggregation.running_mean(cents, ["user_id"], ["event_id"], "cents").select("event_id", F.round("running_mean", 6).alias("running_mean"))


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS step FROM events")
def index_diff(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", (F.lead("event_id").over(w) - F.col("event_id")).alias("step"))


@query("SELECT event_id, event_type, round(value / max(value) OVER (PARTITION BY event_type), 6) AS share FROM events")
def score_over_max(spark, d):
    return selection.share_of_max(table(spark, d, "events"), ["event_type"], "value").select("event_id", "event_type", F.round("share", 6).alias("share"))


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, round((value - lo) / (hi - lo), 6) AS scaled FROM events, e WHERE (value - lo) / (hi - lo) > 0.5E0")
def minmax_filter(spark, d):
    return selection.min_max(table(spark, d, "events"), "value").where("scaled > 0.5").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey LIMIT 1")
def random_frame(spark, d):
    return ranking.pick_one(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 42)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT o_orderkey AS match, (o_orderkey % 2 + 1)::INT AS half, 'm' || o_orderkey || '/' || (o_orderkey % 2 + 1) || '_HQ/frames/' || lpad((o_custkey + 1)::VARCHAR, 5, '0') || '.jpg' AS path FROM orders")
def frame_paths(spark, d):
    from pitchgrid.sources.worklist import frame_path

    half = (F.col("o_orderkey") % 2 + 1).cast("int")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("match"), half.alias("half"), frame_path(F.concat(F.lit("m"), "o_orderkey"), half, F.col("o_custkey")).alias("path"))


@query("SELECT o_orderstatus AS match, extract(month FROM o_orderdate)::INT % 2 + 1 AS half, count(*) AS n_flow FROM orders GROUP BY ALL")
def flow_frame_counts(spark, d):
    half = (F.month("o_orderdate") % 2 + 1).cast("int")
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("match"), half.alias("half")).agg(F.count("*").alias("n_flow"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE NULL END AS category FROM events")
def tag_categories(spark, d):
    from pitchgrid.sources.annotations import tag_category

    return table(spark, d, "events").select("event_id", tag_category(F.col("event_type"), {"click": 0, "view": 1, "error": 2}).alias("category"))


@query("SELECT p_partkey, list_filter(range(0, 10), lambda x: x % 3 <> p_size % 3) AS rest FROM part")
def untested_indices(spark, d):
    every = F.sequence(F.lit(0), F.lit(9))
    tested = F.filter(every, lambda x: x % 3 == F.col("p_size") % 3)
    return table(spark, d, "part").select("p_partkey", F.array_except(every, tested).cast("array<bigint>").alias("rest"))


@query(with_sql("det", "seg") + "SELECT s % 10 AS match, count(*) AS people FROM seg WHERE class_id = 0 GROUP BY 1")
def people_per_match(spark, d):
    return A.segmentation(spark, d).where("class_id = 0").groupBy((F.col("s") % 10).alias("match")).agg(F.count("*").alias("people"))


@query(with_sql("det") + "SELECT frame_idx, det_idx, x1, y1, x1 + (x2 - x1) AS x2, y1 + (y2 - y1) AS y2 FROM det WHERE q > 30")
def annotated_boxes(spark, d):
    b = F.col("bbox")
    rows = A.detections(spark, d).where("q > 30")
    return rows.select("frame_idx", "det_idx", G.corners(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]).alias("b")).select("frame_idx", "det_idx", "b.*")


# stored stages and scans of files: tables are written in the shared folder and read by the engine's own readers

def _match_half() -> list:
    """match and half of a frame number."""
    match = F.concat(F.lit("m"), (F.col("frame_idx") % 10).cast("string"))
    return [match.alias("match"), (F.col("frame_idx") % 2 + 1).cast("int").alias("half")]


def _stored(spark: SparkSession, rows: DataFrame, name: str, ddl: str) -> DataFrame:
    """rows written as a stage's result and read back under the stage's schema."""
    from pitchgrid.sources.shared import new_path
    from pitchgrid.sources.sinks import write_stage

    path = new_path(spark, name)
    write_stage(rows.to(spark.createDataFrame([], ddl).schema), path)
    return spark.read.schema(ddl).parquet(path)


@query(
    with_sql("det", "seg")
    + """SELECT 'm' || frame_idx % 10 AS match, (frame_idx % 2 + 1)::INT AS half, frame_idx, seg_idx, round(score::FLOAT::DOUBLE, 6) AS score, x1, y1, x2, y2 FROM seg
    WHERE class_id = 0 AND score::FLOAT::DOUBLE > 0.65E0"""
)
def segmentation_scan(spark, d):
    from pitchgrid.schema import SEGMENTATION
    from pitchgrid.sources.readers import read_segmentation
    from pitchgrid.sources.shared import new_path
    from pitchgrid.sources.sinks import write_stage

    path = new_path(spark, "segmentation")
    rows = A.segmentation(spark, d).select(*_match_half(), *[F.col(c).cast("int").alias(c) for c in ("frame_idx", "seg_idx")], F.col("class_id").cast("smallint").alias("class_id"), F.col("score").cast("float").alias("score"), "bbox", F.expr("cast(array() as array<array<struct<x:int,y:int>>>)").alias("mask"))
    write_stage(rows.to(spark.createDataFrame([], SEGMENTATION).schema), path)
    people = read_segmentation(spark, path, min_score=0.65, person_only=True)
    return people.select("match", "half", "frame_idx", "seg_idx", F.round(F.col("score").cast("double"), 6).alias("score"), "bbox.*")


@query(ORACLES["result_join"].replace("SELECT o_orderkey AS frame_idx,", "SELECT 'm' || o_orderkey % 10 AS match, (o_orderkey % 2 + 1)::INT AS half, o_orderkey AS frame_idx,"))
def stored_result_join(spark, d):
    """Velocities and team scores are written as their stages write them; the join reads these files."""
    from pitchgrid import schema
    from pitchgrid.plans.match import FRAME

    people = matching.person_index(A.segmentation(spark, d), ["frame_idx"], "seg_idx").select(*_match_half(), "frame_idx", "person_idx", "score", "bbox.*")
    motion = aggregation.dominant_orientation(A.flow(spark, d), ["frame", "person"])
    motion = motion.select(F.col("person").alias("frame_idx"), F.col("frame").alias("person_idx"), "vx", "vy").select(*_match_half(), *[F.col(c).cast("int").alias(c) for c in ("frame_idx", "person_idx")], "vx", "vy")
    teams = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_idx"), F.col("label").alias("person_idx"), F.col("embedding").cast("array<float>").alias("logits"))
    teams = teams.select(*_match_half(), *[F.col(c).cast("int").alias(c) for c in ("frame_idx", "person_idx")], "logits")
    velocity, scores = _stored(spark, motion, "velocity", schema.VELOCITY), _stored(spark, teams, "teams", schema.TEAM_SCORES)
    velocity = velocity.withColumns({"vx": F.round("vx", 6), "vy": F.round("vy", 6)})
    scores = scores.select(*FRAME, "person_idx", F.get("logits", F.lit(0)).cast("double").alias("first_logit"))
    return matching.result_join(_frames(spark, d).select(*_match_half(), "frame_idx"), people, velocity, scores, FRAME)


@query(
    with_sql("det")
    + """, m AS (SELECT frame_idx // 100 AS match, frame_idx % 100 AS frame_idx, det_idx FROM det)
    SELECT o_orderkey // 100 AS match, o_orderkey % 100 AS frame_idx, det_idx FROM orders JOIN m ON m.match = o_orderkey // 100 AND m.frame_idx = o_orderkey % 100 // 2"""
)
def repaired_gather(spark, d):
    from pitchgrid.sources.sinks import gather_repaired

    match = F.floor(F.col("frame_idx") / 100).alias("match")
    frames = A.detections(spark, d).select(match, (F.col("frame_idx") % 100).alias("frame_idx"), "det_idx")
    repaired = _frames(spark, d).select(match, (F.col("frame_idx") % 100).alias("frame_idx"), F.floor(F.col("frame_idx") % 100 / 2).alias("all_frame_idx"))
    return gather_repaired(frames, repaired, ["match"])


@query("SELECT 'm' || o_orderkey || '/' || o_orderpriority AS path FROM orders")
def worklist_scan(spark, d):
    from pitchgrid.sources.shared import new_path
    from pitchgrid.sources.worklist import read_worklist

    path = new_path(spark, "worklist")
    table(spark, d, "orders").select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string"), F.lit("/"), "o_orderpriority", F.lit("  "))).write.text(path)
    return read_worklist(spark, path)


@query("SELECT 'm' || o_orderkey AS match_path, 1 AS half, (o_custkey % 6000)::INT AS n_flow FROM orders UNION ALL SELECT 'm' || o_orderkey, 2, (o_orderkey % 5400)::INT FROM orders")
def flow_count_scan(spark, d):
    from pitchgrid.sources.readers import read_flow_counts
    from pitchgrid.sources.shared import new_path

    path = new_path(spark, "flow-counts")
    rows = table(spark, d, "orders").select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("match_path"), (F.col("o_custkey") % 6000).alias("num_frames_first_half"), (F.col("o_orderkey") % 5400).alias("num_frames_second_half"))
    rows.write.option("header", True).csv(path)
    return read_flow_counts(spark, path)


@query(
    with_sql("det")
    + """, r AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 4E0 / 3 WHEN 1 THEN 16E0 / 15 WHEN 2 THEN 1E0 ELSE 3E0 / 4 END AS sar FROM supplier)
    SELECT 'm' || s AS match, frame_idx, det_idx, trunc(CASE WHEN sar > 1 THEN x1 * sar ELSE x1 END)::INT AS x1, trunc(y1)::INT AS y1, trunc(CASE WHEN sar > 1 THEN x2 * sar ELSE x2 END)::INT AS x2, trunc(y2)::INT AS y2
    FROM det JOIN r ON s = s_suppkey"""
)
def aspect_ratio_lookup(spark, d):
    from pitchgrid.sources.readers import read_aspect_ratios, scaled_detections
    from pitchgrid.sources.shared import new_path

    path, s = new_path(spark, "aspect-ratios"), F.col("s_suppkey") % 4
    sar = F.when(s == 0, "4:3").when(s == 1, "16:15").when(s == 2, "N/A").otherwise("3:4").alias("SAR")
    table(spark, d, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("match_path"), sar).write.option("header", True).csv(path)
    rows = A.detections(spark, d).select(F.concat(F.lit("m"), F.col("s").cast("string")).alias("match"), "frame_idx", "det_idx", "bbox")
    return scaled_detections(rows, read_aspect_ratios(spark, path)).select("match", "frame_idx", "det_idx", "bbox.*")


@query(
    with_sql("det")
    + """SELECT 'f' || frame_idx AS asset, (row_number() OVER (PARTITION BY frame_idx ORDER BY s % 5, x1, y1, x2, y2) - 1)::INT AS region_idx, (s % 5)::INT AS category, x1, y1, x2, y2 FROM det WHERE q > 20"""
)
def annotation_roundtrip(spark, d):
    """Boxes become annotation documents; their regions are read from the text of these."""
    from pitchgrid.schema import ANNOTATION
    from pitchgrid.sources.annotations import annotation_json, regions_of

    boxes = A.detections(spark, d).where("q > 20").select(F.concat(F.lit("f"), F.col("frame_idx").cast("string")).alias("asset"), (F.col("s") % 5).cast("int").alias("category"), "bbox")
    parsed = annotation_json(boxes).select(F.from_json("value", ANNOTATION).alias("a"))
    return regions_of(parsed.select(F.col("a.asset.name").alias("name"), "a.regions")).select("asset", "region_idx", "category", "bbox.*")


@query(with_sql("det") + "SELECT frame_idx, det_idx, trunc((x1 + x2) / 2)::DOUBLE AS x, y2 AS y FROM det")
def foot_point(spark, d):
    x, y = G.foot_point(F.col("bbox"))
    return A.detections(spark, d).select("frame_idx", "det_idx", x.alias("x"), y.alias("y"))


@query(
    """WITH t AS (SELECT event_id, round(value * 900E0 * 1000000)::BIGINT AS us FROM events WHERE value >= 0), w AS (SELECT *, us // 1000000 AS s, us % 1000000 AS r FROM t)
    SELECT event_id, CASE s // 86400 WHEN 0 THEN '' WHEN 1 THEN '1 day, ' ELSE s // 86400 || ' days, ' END || s % 86400 // 3600 || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0')
      || CASE r WHEN 0 THEN '' ELSE '.' || lpad(r::VARCHAR, 6, '0') END AS clock, round(us / 1000000E0, 6) AS seconds FROM w"""
)
def clock_times(spark, d):
    from pitchgrid.functions.clock import clock_seconds, clock_text

    rows = table(spark, d, "events").where("value >= 0").select("event_id", clock_text(F.col("value") * 900.0).alias("clock"))
    return rows.withColumn("seconds", F.round(clock_seconds(F.col("clock")), 6))


@query(
    """WITH m AS (SELECT label, k, avg(embedding[k]::DOUBLE) AS m FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(k) GROUP BY ALL),
    e AS (SELECT vec_id, label, round(avg((embedding[k]::DOUBLE - m) * (embedding[k]::DOUBLE - m)), 9) AS mse FROM embeddings JOIN m USING (label) WHERE k <= len(embedding) GROUP BY ALL)
    SELECT vec_id, label, mse FROM e WHERE mse < 0.0155E0"""
)
def overlay_similarity(spark, d):
    """Patches that look like the mean patch of their group."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("values"))
    joined = e.join(aggregation.mean_vectors(e, ["label"]), "label")  # one mean per group
    return joined.select("vec_id", "label", F.round(V.squared_error(F.col("values"), F.col("mean")), 9).alias("mse")).where("mse < 0.0155")


_FIXED = ([0.125] * 8, [1.0] + [0.0] * 7, [0.0] * 4 + [0.25] * 4)


@query(
    with_sql("hist", "members")
    + f", e AS (SELECT category, id, list_sort([{', '.join(f'coalesce({bhattacharyya_sql("hist", str(v) + "::DOUBLE[]")}, 1E0)' for v in _FIXED)}]) AS d FROM members)"
    + "SELECT category, id, round(d[1], 6) AS nearest, round(d[2], 6) AS middle FROM e"
)
def component_distances(spark, d):
    from pitchgrid.models.clustering import Mixture
    from pitchgrid.models.labelling import mixture_distance

    fixed = Mixture(np.full(3, 1 / 3), np.array(_FIXED), np.zeros((3, 8, 8)))
    both = {"nearest": mixture_distance(fixed, "min"), "middle": mixture_distance(fixed, "median")}
    return A.members(spark, d).select("category", "id", *[F.round(c, 6).alias(k) for k, c in both.items()])


@query("WITH c AS (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1) SELECT vec_id, cluster, n FROM embeddings JOIN c ON cluster = label WHERE n > (SELECT avg(n) FROM c)")
def large_cluster_members(spark, d):
    from pitchgrid.models.labelling import large_clusters

    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    mean = rows.groupBy("cluster").count().agg(F.avg("count")).first()[0] or 0.0
    return rows.join(large_clusters(rows, mean), "cluster").select("vec_id", "cluster", "n")


@query(
    with_sql("hist", "members")
    + f""", h AS (SELECT category * 1000000 + id AS key, hist FROM members),
    c AS (SELECT row_number() OVER (ORDER BY md5('42:' || key), key) - 1 AS c, hist AS centre FROM h QUALIFY c < 4),
    a AS (SELECT key, hist, arg_min(c, (d, c)) AS c FROM (SELECT key, h.hist, c, coalesce({bhattacharyya_sql("h.hist", "c.centre")}, 'inf'::DOUBLE) AS d FROM h, c) GROUP BY key, hist)
    SELECT c::INT AS cluster, k - 1 AS pos, round(avg(hist[k]), 9) AS mean FROM a, unnest(range(1, 9)) AS r(k) GROUP BY c, k"""
)
def bhattacharyya_round(spark, d):
    """One round of k-means under the Bhattacharyya distance, from four fixed histograms."""
    from pitchgrid.models import clustering

    rows = A.members(spark, d).select((F.col("category") * 1000000 + F.col("id")).alias("key"), "hist")
    starts = clustering.first_centres(rows, "hist", "key", 4)
    each = rows.select(clustering.nearest(F.col("hist"), starts, V.bhattacharyya).alias("cluster"), F.posexplode("hist").alias("pos", "v"))
    return each.groupBy("cluster", F.col("pos").cast("bigint").alias("pos")).agg(F.round(F.avg("v"), 9).alias("mean"))


@query(
    with_sql("det")
    + """, b AS (SELECT frame_idx, det_idx, s % 4 AS category, x2 - x1 AS w, y2 - y1 AS h FROM det),
    g AS (SELECT category, avg(w) AS mw, avg(h) AS mh, avg(w * w) - avg(w) * avg(w) + 1E-6 AS vw, avg(h * h) - avg(h) * avg(h) + 1E-6 AS vh, avg(w * h) - avg(w) * avg(h) AS c FROM b GROUP BY 1),
    l AS (SELECT b.*, -0.5E0 * (vh * (w - mw) * (w - mw) - 2 * c * (w - mw) * (h - mh) + vw * (h - mh) * (h - mh)) / (vw * vh - c * c) - 0.5E0 * ln(vw * vh - c * c) - ln(2 * pi()) AS ll FROM b JOIN g USING (category)),
    r AS (SELECT *, max(ll) OVER (PARTITION BY category) AS best FROM l)
    SELECT frame_idx, det_idx, category FROM r WHERE CASE WHEN best > 0 THEN ll / best ELSE best / ll END > 0.9123E0"""
)
def relative_likelihood(spark, d):
    from pitchgrid.models.labelling import relative_likelihood_filter

    size = F.array(F.col("bbox.x2") - F.col("bbox.x1"), F.col("bbox.y2") - F.col("bbox.y1")).alias("hist")
    rows = A.detections(spark, d).select("frame_idx", "det_idx", (F.col("s") % 4).alias("category"), size)
    return relative_likelihood_filter(rows, 0.9123).select("frame_idx", "det_idx", "category")


@query(
    ORACLES["dark_bright_pair"].split("\n    SELECT a.category AS dark")[0]
    + f""", pair AS (SELECT a.category AS dark, b.category AS bright FROM hm a JOIN hm b ON a.side = 0 AND b.side = 1
      ORDER BY round({bhattacharyya_sql('a.md', 'b.md')}, 9), 1, 2 LIMIT 1)
    SELECT id, id % 2 = 0 AS is_dark, CASE WHEN id % 2 = 1 AND category IN (1, 2) AND (SELECT dark <> bright FROM pair) THEN 3 - category ELSE category END AS category FROM members"""
)
def dark_bright_union(spark, d):
    from pitchgrid.models.labelling import with_names_of

    m = A.members(spark, d).withColumn("is_dark", F.col("id") % 2 == 0)
    return with_names_of(m.where("is_dark"), m.where("not is_dark")).select("id", "is_dark", "category")


@query(
    """WITH c AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 101 % 256 AS g, p_size * 53 % 256 AS b FROM part), x AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c),
    y AS (SELECT *, CASE WHEN hi > lo THEN hi - lo ELSE 1 END::DOUBLE AS span FROM x),
    z AS (SELECT *, CASE WHEN hi = lo THEN 0E0 WHEN hi = r THEN (g - b) / span WHEN hi = g THEN 2 + (b - r) / span ELSE 4 + (r - g) / span END * 60 AS hue FROM y)
    SELECT p_partkey, round_even(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2, 0)::INT % 180 AS hue, round_even(255 * (hi - lo) / CASE WHEN hi > 0 THEN hi ELSE 1 END::DOUBLE, 0)::INT AS saturation, hi::INT AS brightness FROM z"""
)
def hsv_colours(spark, d):
    """One pixel a row through the colour conversion that histograms use, in Arrow batches."""
    from pitchgrid.functions.pixels import to_hsv

    @F.arrow_udf("struct<hue:int,saturation:int,brightness:int>")
    def hsv(r: pa.Array, g: pa.Array, b: pa.Array) -> pa.Array:
        out = to_hsv(np.stack([np.asarray(c, np.uint8) for c in (r, g, b)], axis=-1)).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(3)], ["hue", "saturation", "brightness"])

    key = F.col("p_partkey")
    pixel = [(c % 256).cast("int") for c in (key * 37, key * 101, F.col("p_size") * 53)]
    return table(spark, d, "part").select("p_partkey", hsv(*pixel).alias("c")).select("p_partkey", "c.*")


@query(
    """SELECT 'm' || o_custkey % 50 AS match, (1 + o_custkey % 2)::INT AS half, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, min(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 2 END)::INT AS first_run
    FROM (SELECT * REPLACE (o_custkey % 50 AS o_custkey) FROM orders) GROUP BY ALL"""
)
def published_stage(spark, d):
    """A stage in three runs: one is lost before it publishes, one does a third of the halves, the last one does the rest."""
    from pitchgrid.sources import manifest

    root = new_path(spark, "stages")
    match = F.col("o_custkey") % 50
    orders = table(spark, d, "orders").select(F.concat(F.lit("m"), match.cast("string")).alias("match"), (1 + match % 2).cast("int").alias("half"), F.col("o_orderkey").cast("bigint").alias("k"), (match % 3).alias("third"))
    work = orders.select("match", "half", "third").distinct()
    rows = lambda left, run: orders.join(left.select("match", "half"), ["match", "half"]).select("match", "half", "k", F.lit(run).alias("run"))
    manifest.write_version(rows(work, 0), root, "people")
    manifest.run_stage(work.where("third = 0"), root, "people", lambda left: rows(left, 1))
    manifest.run_stage(work, root, "people", lambda left: rows(left, 2))
    out = manifest.read_published(spark, root, "people", "k bigint, run int")
    return out.groupBy("match", "half").agg(F.count("*").alias("n"), F.sum("k").alias("keys"), F.min("run").alias("first_run"))


# sequential alignment, and learned models without SQL, whose invariants are tested


@query()
def kmeans_assign(spark, d):
    from pitchgrid.models import clustering

    return clustering.kmeans(A.members(spark, d), "hist", 3).select("category", "id", "cluster")


@query()
def gmm_size_filter(spark, d):
    from pitchgrid.models import clustering

    rows = A.detections(spark, d).select("frame_idx", "det_idx", F.array(F.col("bbox.x2") - F.col("bbox.x1"), F.col("bbox.y2") - F.col("bbox.y1")).alias("size"))
    return clustering.likely_sizes(rows, "size", 5, 0.5).select("frame_idx", "det_idx", F.round("scaled", 6).alias("scaled"))


@query()
def fixpoint_growth(spark, d):
    from pitchgrid.models import labelling

    m = A.members(spark, d).withColumn("id", F.col("id") * 10 + F.col("category"))
    return labelling.label_players(m.select("id", "hist"), clusters=6, min_cluster=20, min_probability=0.5, min_candidate_likelihood=0.5).select("id", "category", F.round("probability", 6).alias("probability"))


# 100 orders stand for one video; each of its frames is shown twice. All pairs' overlaps, then the mean of the smaller side's best
_WINDOW_SCORES = """, d AS (SELECT frame_idx // 100 AS match, frame_idx % 100 AS f, det_idx AS i, x1, y1, x2, y2, count(*) OVER (PARTITION BY frame_idx) AS n_d FROM det),
    s AS (SELECT frame_idx // 100 AS match, frame_idx % 100 * 2 AS v, seg_idx AS j, x1, y1, x2, y2, count(*) OVER (PARTITION BY frame_idx) AS n_s FROM seg),
    size AS (SELECT match, n, coalesce(m, 0) AS m, coalesce(2 * m // n, 0) AS step FROM (SELECT match, max(f) + 1 AS n FROM d GROUP BY match) LEFT JOIN (SELECT match, max(v) + 1 AS m FROM s GROUP BY match) USING (match)),
    sides AS (SELECT d.match, d.f, s.v, d.i, s.j, n_d, n_s, greatest(0, least(d.x2, s.x2) - greatest(d.x1, s.x1) + 1) * greatest(0, least(d.y2, s.y2) - greatest(d.y1, s.y1) + 1) AS shared,
      (d.x2 - d.x1 + 1) * (d.y2 - d.y1 + 1) + (s.x2 - s.x1 + 1) * (s.y2 - s.y1 + 1) AS total FROM d JOIN s USING (match) {0}),
    chosen AS (SELECT match, f, v, CASE WHEN n_d <= n_s THEN i ELSE j END AS c, max(shared::DOUBLE / (total - shared)) AS o FROM sides GROUP BY ALL),
    scores AS MATERIALIZED (SELECT match, f, v, round(avg(o), 9) AS score FROM chosen GROUP BY ALL)"""


def _videos(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    match = F.expr("frame_idx div 100").alias("match")
    det = A.detections(spark, d).select(match, (F.col("frame_idx") % 100).alias("frame_idx"), "bbox")
    return det, A.segmentation(spark, d).select(match, (F.col("frame_idx") % 100 * 2).alias("frame_idx"), "bbox")


@query(
    with_sql("det", "seg")
    + _WINDOW_SCORES.format("JOIN size z USING (match) WHERE s.v BETWEEN f * m // n - z.step AND f * m // n + z.step - 1")
    + "SELECT match, f AS frame_idx, v AS video_idx, score FROM scores"
)
def window_band_scores(spark, d):
    """Scores of each detection frame with the video frames within a step of the expected place."""
    from pitchgrid.operators import alignment

    detected, video = (alignment.boxes_by_frame(rows, ["match"]) for rows in _videos(spark, d))
    size = [rows.groupBy("half_id").agg((F.max("frame_idx") + 1).alias(n)) for rows, n in ((detected, "n"), (video, "m"))]
    at = F.expr("frame_idx * m div n")
    bands = detected.join(size[0].join(size[1], "half_id"), "half_id").withColumn("step", F.expr("2 * m div n"))
    bands = bands.withColumns({"first": F.greatest(at - F.col("step"), F.lit(0)), "beyond": F.least(at + F.col("step"), F.col("m"))})
    scores = alignment.band_scores(bands.select("half_id", "frame_idx", "boxes", "first", "beyond"), video)
    return scores.select(F.get_json_object("half_id", "$.match").cast("bigint").alias("match"), "frame_idx", "video_idx", "score")


@query(
    with_sql("det", "seg").replace("WITH ", "WITH RECURSIVE ", 1)
    + _WINDOW_SCORES.format("")
    + """, people AS (SELECT DISTINCT match, f FROM d),
    walk AS (SELECT match, -1::BIGINT AS f, n, m, step, 0::BIGINT AS low, least(step, m)::BIGINT AS high, 0::BIGINT AS found, 0::DOUBLE AS best FROM size
      UNION ALL SELECT match, f + 1, n, m, step,
        CASE WHEN v IS NULL THEN low ELSE greatest(v + step // 4, 0) END, CASE WHEN v IS NULL THEN least(low + 10 * step, m) ELSE least(v + ceil(4 * step / 5E0)::BIGINT, m) END,
        coalesce(v, low + step // 2), CASE WHEN v IS NULL THEN 3E0 ELSE score END
      FROM (SELECT w.*, CASE WHEN p.f IS NULL THEN NULL ELSE coalesce(c.v, -1) END AS v, CASE WHEN c.v IS NULL THEN -1E0 ELSE coalesce(x.score, -1E0) END AS score,
          row_number() OVER (PARTITION BY w.match ORDER BY
            CASE WHEN coalesce(x.score, -1E0) >= 0.5E0 THEN c.ring ELSE 1000 END, coalesce(x.score, -1E0) DESC, c.ring, c.v) AS place
        FROM walk w LEFT JOIN people p ON p.match = w.match AND p.f = w.f + 1
        LEFT JOIN (SELECT match, v, low, high, CASE WHEN v >= low AND v < high THEN 0 WHEN v < low THEN ceil((low - v) / (step // 2)::DOUBLE) ELSE ceil((v - high + 1) / (step // 2)::DOUBLE) END AS ring
          FROM (SELECT w.match, w.low, w.high, w.step, unnest(range(greatest(w.low - 29 * (w.step // 2), 0), least(w.high + 29 * (w.step // 2), w.m))) AS v FROM walk w WHERE w.low < w.high)) c
          ON c.match = w.match AND p.f IS NOT NULL
        LEFT JOIN scores x ON x.match = w.match AND x.f = w.f + 1 AND x.v = c.v
        WHERE w.f + 1 < w.n) WHERE place = 1)
    SELECT match, f AS frame_idx, found::INT AS all_frame_idx, round(best, 6) AS mean_iou FROM walk WHERE f >= 0"""
)
def align_windows(spark, d):
    from pitchgrid.operators.alignment import align

    return align(*_videos(spark, d), ["match"])


@query(
    """WITH r AS (SELECT label AS y, p, embedding[p + 1]::DOUBLE AS x FROM embeddings, range(64) t(p) WHERE len(embedding) = 64 UNION ALL SELECT label, 64, 1 FROM embeddings WHERE len(embedding) = 64)
    SELECT (c * 65 + p)::INT AS place, round(sum((0.1E0 - (y = c)::INT) * x), 6) + 0E0 AS total FROM r, range(10) k(c) GROUP BY c, p"""
)
def epoch_gradient(spark, d):
    """The summed gradient of the first step of training, from weights of zero."""
    from pitchgrid.models.epochs import summed_gradient

    sums = summed_gradient(table(spark, d, "embeddings"), "embedding", "label", np.zeros((10, 65))).where("place < 650")
    return sums.select("place", (F.round("total", 6) + 0.0).alias("total"))


@query()
def epoch_training(spark, d):
    """Losses of three epochs over a stratified split of all vectors."""
    from pitchgrid.models.epochs import train_epochs

    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("category"), F.col("embedding").cast("array<double>").alias("hist"))
    parts = checkpointed(ranking.stratified_split(rows, "category", "vec_id", 0.2))
    config = TrainingConfig(classes=10, max_epochs=3, max_steps=4, learning_rate=0.01)
    states = train_epochs(parts.where("split = 'train'"), parts.where("split = 'valid'"), "hist", "category", "vec_id", 64, config, new_path(spark, "states"))
    return states.select("epoch", *[F.round(c, 6).alias(c) for c in ("train_loss", "valid_loss", "accuracy")], "learning_rate")


@query()
def team_classifier(spark, d):
    from pitchgrid.models import classifier

    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("category"), F.col("embedding").cast("array<double>").alias("hist"))
    split = ranking.stratified_split(rows, "category", "vec_id", 0.2)
    model = classifier.fit(split.where("split = 'train'"), "hist", "category")
    return classifier.classify(model, rows, "hist").select("vec_id", F.transform("logits", lambda x: F.round(x, 4)).alias("logits"))
