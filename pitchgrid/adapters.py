"""Projections of the driver's tables to the logical tables of the engine, by integer arithmetic.

The tables hold no boxes, flow or histograms; these deterministic stand-ins have the same shapes and hit both outcomes of
every filter. ``SQL`` has the same projections as common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchgrid.functions import geometry as G

#: Lines that a task numbers within their frames: beyond that for each shuffle partition, there are more partitions.
LINES_PER_TASK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, det_idx, bbox, onfield and the keys p, s, q of the line it comes from.

    Lines are dealt by the frame, which joins and windows by frame then keep; over so many tasks that none sorts many more than LINES_PER_TASK.
    """
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "frame_idx")
    parts = -(-lines.count() // LINES_PER_TASK)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines = lines.repartition(parts, "frame_idx")
    order = W.partitionBy("frame_idx").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    x1, y1 = p % 40 * 8, s % 10 * 16
    return lines.select(
        "frame_idx", F.row_number().over(order).cast("bigint").alias("det_idx"),
        G.box(x1, y1, x1 + 40 + s % 30, y1 + 80 + p % 40).alias("bbox"), (F.col("l_quantity") > 3).alias("onfield"),
        p.alias("p"), s.alias("s"), F.col("l_quantity").cast("bigint").alias("q"),
    )


def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, seg_idx, class_id, score, bbox: jittered detections and unrelated boxes."""
    d = detections(spark, sf_dir)
    b, shift = F.col("bbox"), F.when(F.col("s") % 3 == 0, 30).otherwise(0)
    near = d.where((F.col("p") + F.col("s")) % 5 != 0).select(
        "frame_idx", F.col("det_idx").alias("seg_idx"),
        G.box(b["x1"] + F.col("p") % 5 + shift, b["y1"] + F.col("s") % 7, b["x2"] + shift, b["y2"] - 2).alias("bbox"), "p", "s",
    )
    far = d.where(F.col("p") % 4 == 0).select(
        "frame_idx", (F.col("det_idx") + 100).alias("seg_idx"), G.box(b["x1"] + 200, b["y1"], b["x1"] + 250, b["y1"] + 90).alias("bbox"), "p", "s"
    )
    out = near.unionByName(far)
    return out.select("frame_idx", "seg_idx", "bbox", (F.col("s") % 4).alias("class_id"), ((F.col("p") % 100) / 100.0).alias("score"), "p", "s")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, confidence, homography, and a foot point px, py."""
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    h = F.array(*[x.cast("double") for x in (1 + c % 3 * F.lit(0.01), F.lit(0.02), 53 + c % 5, F.lit(0.01), F.lit(1.1), F.lit(34), F.lit(0.0001), F.lit(0.0002), F.lit(1))])
    return o.select(
        F.col("o_orderkey").alias("frame_idx"), (c % 100 / 100.0).alias("confidence"), h.alias("homography"),
        (c % 107).cast("double").alias("px"), (F.col("o_orderkey") % 69).cast("double").alias("py"), c.alias("c"),
    )


def foot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People on the pitch: one per order, ten orders a frame, with radar position and goal distance."""
    people = calibration(spark, sf_dir)
    x, y = G.unproject(F.col("homography"), F.col("px") + F.col("homography")[2], F.col("py") + F.col("homography")[5])
    rx, ry = G.radar(x - 52.5, y - 34)
    out = people.select((F.floor(F.col("frame_idx") / 10)).alias("frame"), F.col("frame_idx").alias("idx"), rx.alias("radar_x"), ry.alias("radar_y"), "confidence", "c")
    return out.withColumn("goal_dist", G.goal_distance(F.col("radar_x"), F.col("radar_y")))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, person, pos, u, v: the embeddings' numbers in pairs."""
    e = table(spark, sf_dir, "embeddings")
    pair = F.transform(F.sequence(F.lit(0), F.size("embedding") - 2, F.lit(2)), lambda i: F.struct(F.get("embedding", i).cast("double").alias("u"), F.get("embedding", i + 1).cast("double").alias("v")))
    return e.select(F.col("label").alias("frame"), F.col("vec_id").alias("person"), F.posexplode(pair).alias("pos", "uv")).select("frame", "person", "pos", "uv.u", "uv.v")


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, hist: 8-bin histograms of the events' values per user."""
    from pitchgrid.operators.aggregation import dense_histograms, histogram

    h = histogram(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", 8, 0.0, 500.0)
    return dense_histograms(h, ["user_id", "event_type"], 8)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category 0..4, id, hist: the users' histograms, their event type as class."""
    types = ["click", "error", "purchase", "signup", "view"]
    h = histograms(spark, sf_dir)
    number = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("event_type")) - 1
    return h.select(number.cast("int").alias("category"), F.col("user_id").alias("id"), "hist").where("category >= 0")


SQL = {
    "det": """det AS (
  SELECT l_orderkey AS frame_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS det_idx,
    (l_partkey % 40 * 8)::DOUBLE AS x1, (l_suppkey % 10 * 16)::DOUBLE AS y1, (l_partkey % 40 * 8 + 40 + l_suppkey % 30)::DOUBLE AS x2,
    (l_suppkey % 10 * 16 + 80 + l_partkey % 40)::DOUBLE AS y2, l_quantity > 3 AS onfield, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q FROM lineitem)""",
    "seg": """seg AS (
  SELECT *, s % 4 AS class_id, (p % 100) / 100.0E0 AS score FROM (
    SELECT frame_idx, det_idx AS seg_idx, x1 + p % 5 + d AS x1, y1 + s % 7 AS y1, x2 + d AS x2, y2 - 2 AS y2, p, s
    FROM (SELECT *, CASE WHEN s % 3 = 0 THEN 30 ELSE 0 END AS d FROM det) WHERE (p + s) % 5 <> 0
    UNION ALL SELECT frame_idx, det_idx + 100, x1 + 200, y1, x1 + 250, y1 + 90, p, s FROM det WHERE p % 4 = 0))""",
    "best": """pairs AS (
  SELECT det.frame_idx, det_idx AS l, seg_idx AS r, n_left, n_right,
    greatest(0, least(det.x2, seg.x2) - greatest(det.x1, seg.x1) + 1) * greatest(0, least(det.y2, seg.y2) - greatest(det.y1, seg.y1) + 1) AS i,
    (det.x2 - det.x1 + 1) * (det.y2 - det.y1 + 1) + (seg.x2 - seg.x1 + 1) * (seg.y2 - seg.y1 + 1) AS t
  FROM det JOIN seg USING (frame_idx) JOIN (SELECT frame_idx, count(*) AS n_left FROM det GROUP BY 1) USING (frame_idx)
    JOIN (SELECT frame_idx, count(*) AS n_right FROM seg GROUP BY 1) USING (frame_idx)),
best AS (
  SELECT frame_idx, l, r, n_left, n_right, i / (t - i) AS iou FROM pairs QUALIFY row_number() OVER (
    PARTITION BY frame_idx, CASE WHEN n_left <= n_right THEN l ELSE r END
    ORDER BY i / (t - i) DESC, CASE WHEN n_left <= n_right THEN r ELSE l END) = 1)""",
    "cal": """cal AS (
  SELECT o_orderkey AS frame_idx, o_custkey % 100 / 100.0E0 AS confidence, 1 + o_custkey % 3 * 0.01E0 AS h0, 0.02E0 AS h1, (53 + o_custkey % 5)::DOUBLE AS h2,
    0.01E0 AS h3, 1.1E0 AS h4, 34E0 AS h5, 0.0001E0 AS h6, 0.0002E0 AS h7, 1E0 AS h8, (o_custkey % 107)::DOUBLE AS px, (o_orderkey % 69)::DOUBLE AS py, o_custkey AS c FROM orders)""",
    "foot": """inv AS (
  SELECT *, px + h2 AS ix, py + h5 AS iy FROM cal),
pitch AS (
  SELECT frame_idx, confidence, c,
    ((h4*h8-h5*h7)*ix + (h2*h7-h1*h8)*iy + (h1*h5-h2*h4)) / ((h3*h7-h4*h6)*ix + (h1*h6-h0*h7)*iy + (h0*h4-h1*h3)) AS x,
    ((h5*h6-h3*h8)*ix + (h0*h8-h2*h6)*iy + (h2*h3-h0*h5)) / ((h3*h7-h4*h6)*ix + (h1*h6-h0*h7)*iy + (h0*h4-h1*h3)) AS y FROM inv),
foot AS (
  SELECT *, least(sqrt(radar_x * radar_x + (radar_y - 16) * (radar_y - 16)), sqrt((radar_x - 64) * (radar_x - 64) + (radar_y - 16) * (radar_y - 16))) AS goal_dist
  FROM (SELECT frame_idx // 10 AS frame, frame_idx AS idx, 64 * (0.95E0 * (x - 52.5E0) / 105 + 0.525E0) AS radar_x, 32 * (0.95E0 * (y - 34) / 68 + 0.525E0) AS radar_y, confidence, c FROM pitch))""",
    "flow": """flow AS (
  SELECT label AS frame, vec_id AS person, k AS pos, embedding[2*k+1]::DOUBLE AS u, embedding[2*k+2]::DOUBLE AS v
  FROM embeddings, unnest(range(0, len(embedding) // 2)) AS r(k))""",
    "moments": """moments AS (
  SELECT frame, person, sum(u*u) AS suu, sum(v*v) AS svv, sum(u*v) AS suv, count(*) AS n, count(*) FILTER (u >= 0 AND u <= 1) AS uu, count(*) FILTER (u >= -1 AND u < 0) AS ud,
    count(*) FILTER (v >= 0 AND v <= 1) AS vu, count(*) FILTER (v >= -1 AND v < 0) AS vd FROM flow GROUP BY ALL),
orient AS (
  SELECT *, (suu + svv) / n * CASE WHEN uu > ud THEN 1 ELSE -1 END * abs(cos(0.5E0 * atan2(2 * suv, suu - svv))) AS vx,
    (suu + svv) / n * CASE WHEN vu > vd THEN 1 ELSE -1 END * abs(sin(0.5E0 * atan2(2 * suv, suu - svv))) AS vy FROM moments)""",
    "hist": """bins AS (
  SELECT user_id, event_type, least(7, floor(value / 62.5E0))::INT AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 500 GROUP BY ALL),
hist AS (
  SELECT user_id, event_type, list(coalesce(n, 0) / t::DOUBLE ORDER BY b) AS hist FROM (
    SELECT g.user_id, g.event_type, b, n, t FROM (SELECT user_id, event_type, sum(n) AS t FROM bins GROUP BY ALL) g CROSS JOIN unnest(range(8)) AS r(b)
    LEFT JOIN bins ON bins.user_id = g.user_id AND bins.event_type = g.event_type AND bins.bin = b) GROUP BY ALL)""",
    "members": """members AS (
  SELECT list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::INT - 1 AS category, user_id AS id, hist FROM hist
  WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view'))""",
    "med": """medpos AS (SELECT category, k, median(hist[k]) AS m FROM members, unnest(range(1, 9)) AS r(k) GROUP BY ALL),
med AS (SELECT category, list(m ORDER BY k) AS median FROM medpos GROUP BY category)""",
}


def with_sql(*names: str) -> str:
    """A WITH clause of the named projections."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"


def bhattacharyya_sql(u: str, v: str) -> str:
    """The histogram distance in DuckDB."""
    shared = f"list_sum(list_transform(list_zip({u}, {v}), lambda z: sqrt(z[1] * z[2])))"
    return f"CASE WHEN list_sum({u}) * list_sum({v}) > 0 THEN sqrt(greatest(0E0, 1 - {shared} / sqrt(list_sum({u}) * list_sum({v})))) END"
