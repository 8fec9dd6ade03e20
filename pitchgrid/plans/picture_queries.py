"""Registered queries that go through pictures and pixel grids, with their DuckDB SQL.

Their pictures are made from the embeddings: 64 numbers are the 8 by 8 pixels of a component of optical flow, as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.adapters import table
from pitchgrid.functions.augment import BITS, ONE, Recipe, resize_weights
from pitchgrid.functions.pictures import png
from pitchgrid.operators.grid import connected_parts, gaussian_smooth, gaussian_weights
from pitchgrid.plans.config import VelocityConfig
from pitchgrid.plans.registry import query
from pitchgrid.schema import BOX, POLYGONS
from pitchgrid.sources.labelled_pictures import evaluation_pictures, list_labelled, training_pictures, write_labelled
from pitchgrid.sources.pictures import FILES_PER_TASK, frame_counts, list_pictures, with_flow, write_pictures
from pitchgrid.sources.readers import read_flow_counts
from pitchgrid.sources.shared import checkpointed, new_path, spread

#: Vectors 0 to 6 are the first flow of seven matches' first halves, 7 to 13 of their second halves, and so on.
_PLACE = "concat('m', cast(vec_id % 7 as string)) as match", "cast(vec_id div 7 % 2 + 1 as int) as half", "cast(vec_id div 14 as int) as i"


def _bytes(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(128 + 100 * values.astype(np.float64)), 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def _pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both flow pictures of each vector, v from the numbers backwards, and every second one's frame: twelve green columns, four red ones."""
    for batch in batches:
        e = np.array(batch["embedding"].to_pylist(), np.float32)
        rows = []
        for r, u, v in zip(batch.select(["vec_id", "match", "half", "i"]).to_pylist(), _bytes(e), _bytes(e[:, ::-1]), strict=True):
            own = {c: r[c] for c in ("match", "half")}
            rows += [own | {"series": s, "number": r["i"], "data": png(x)} for s, x in (("u", u), ("v", v))]
            if r["i"] % 2 == 0:
                rgb = np.full((16, 16, 3), (40, 150 + r["vec_id"] % 20, 50), np.uint8)
                rgb[:, 12:] = (200, 30, 30)
                rows.append(own | {"series": "frames", "number": r["i"] // 2, "data": png(rgb)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("match", pa.string()), ("half", pa.int32()), ("series", pa.string()), ("number", pa.int32()), ("data", pa.binary())]))


def _written(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors with their places, the listing of the pictures, flow counts read from their file)."""
    vectors = table(spark, d, "embeddings").where("size(embedding) = 64").selectExpr("vec_id", "embedding", *_PLACE)
    root = new_path(spark, "pictures")
    write_pictures(spread(vectors, FILES_PER_TASK).mapInArrow(_pictures, "match string, half int, series string, number int, data binary"), root)
    one = lambda h: F.count_if(F.col("half") == h).alias(f"num_frames_{'first' if h == 1 else 'second'}_half")
    path = new_path(spark, "flow-counts")
    vectors.groupBy(F.col("match").alias("match_path")).agg(one(1), one(2)).write.option("header", True).csv(path)
    return vectors, list_pictures(spark, root), read_flow_counts(spark, path)


def _people(vectors: DataFrame) -> DataFrame:
    """Two people in each frame but every fifth one; the first has an outline."""
    f = F.col("frame_idx")
    boxes = [(0, 2 * (f % 3), 2 * (f % 2), [[(0, 0), (5, 0), (5, 3), (0, 3)]]), (1, 4 + 2 * (f % 4), F.lit(8), [])]
    people = [
        F.struct(
            F.lit(k).alias("person_idx"), F.struct(x, y, x + 6, y + (4 if k == 0 else 6)).cast(BOX).alias("bbox"),
            F.array(*[F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in line]) for line in lines]).cast(POLYGONS).alias("mask"),
        )
        for k, x, y, lines in boxes
    ]
    frames = vectors.where("i % 2 = 0").selectExpr("match", "half", "cast(i div 2 as int) as frame_idx").where("frame_idx % 5 <> 4")
    return frames.select("match", "half", "frame_idx", F.explode(F.array(*people)).alias("p")).select("match", "half", "frame_idx", "p.*")


_FLOW = """fl AS (
  SELECT vec_id % 7 AS m, vec_id // 7 % 2 + 1 AS h, vec_id // 14 AS i, k % 8 AS x, k // 8 AS y,
    greatest(0, least(255, floor(128 + 100 * embedding[k + 1]::DOUBLE))) - 128 AS bu, greatest(0, least(255, floor(128 + 100 * embedding[64 - k]::DOUBLE))) - 128 AS bv
  FROM embeddings, range(64) r(k) WHERE len(embedding) = 64),
n AS (SELECT m, h, count(DISTINCT i) AS n_flow, count(DISTINCT i) FILTER (i % 2 = 0) AS n_frames FROM fl GROUP BY m, h),
fr AS (SELECT m, h, f, ceil(n_flow * (f + 1) / n_frames::DOUBLE)::BIGINT - 1 AS i FROM n, unnest(range(n_frames)) r(f))"""

_ORIENT = "CASE WHEN count(*) = 0 THEN 0 ELSE sum(u * u + v * v) / count(*) END * CASE WHEN count(*) FILTER ({0} >= 0 AND {0} <= 1) > count(*) FILTER ({0} >= -1 AND {0} < 0) THEN 1 ELSE -1 END * abs({1}(0.5E0 * atan2(2 * sum(u * v), sum(u * u) - sum(v * v))))"


@query(
    f"""WITH {_FLOW}
    SELECT 'm' || m AS match, h::INT AS half, y::INT AS y, x::INT AS x, round(avg(abs(bu)) / 127.999E0, 9) AS u, round(avg(abs(bv)) / 127.999E0, 9) AS v FROM fr JOIN fl USING (m, h, i) GROUP BY m, h, y, x"""
)
def mean_flow_of_files(spark, d):
    """Both series of flow pictures are listed, paired with frames by the looked-up counts, opened and averaged."""
    from pitchgrid.plans.velocity import mean_flow

    _, listing, counts = _written(spark, d)
    sizes = frame_counts(listing)
    frames = listing.where("series = 'frames'").select("match", "half", F.col("number").alias("frame_idx"))
    flow = mean_flow(with_flow(frames, listing, counts, sizes))
    return flow.select("match", "half", "y", F.col("x").cast("int").alias("x"), F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


_MOTION = f"""    px AS (SELECT m, h, f, (bu::FLOAT / 127.999::FLOAT)::DOUBLE AS u, (bv::FLOAT / 127.999::FLOAT)::DOUBLE AS v, x BETWEEN f % 3 AND f % 3 + 2 AND y BETWEEN f % 2 AND f % 2 + 1 AS first, x BETWEEN 2 + f % 4 AND 4 + f % 4 AND y BETWEEN 4 AND 6 AS second, x < 6 AS green
      FROM fr JOIN fl USING (m, h, i) WHERE f % 5 <> 4),
    g AS (SELECT m, h, f, {_ORIENT.format("u", "cos")} AS gx, {_ORIENT.format("v", "sin")} AS gy FROM px WHERE green AND NOT first GROUP BY m, h, f),
    p AS (SELECT m, h, f, person_idx, {_ORIENT.format("u", "cos")} AS px, {_ORIENT.format("v", "sin")} AS py
      FROM (SELECT *, 0 AS person_idx FROM px WHERE first UNION ALL SELECT *, 1 FROM px WHERE second) GROUP BY m, h, f, person_idx)"""


@query(
    f"""WITH {_FLOW},
{_MOTION}
    SELECT 'm' || m AS match, h::INT AS half, f::INT AS frame_idx, person_idx, round(px - gx, 6) + 0E0 AS vx, round(py - gy, 6) + 0E0 AS vy, round(gx, 6) + 0E0 AS field_vx, round(gy, 6) + 0E0 AS field_vy FROM p JOIN g USING (m, h, f)"""
)
def velocity_of_files(spark, d):
    """Velocities of two people a frame from pictures: the first one's outline is cut out of the field, the second one has none."""
    from pitchgrid.plans.velocity import half_velocities

    vectors, listing, counts = _written(spark, d)
    each = _people(vectors)
    out = half_velocities(each, listing, counts, frame_counts(listing), VelocityConfig(opening_size=1), with_overlays=False)
    return out.select("match", "half", "frame_idx", "person_idx", *[(F.round(c, 6) + 0.0).alias(c) for c in ("vx", "vy", "field_vx", "field_vy")])  # no negative zero


@query(
    f"""WITH {_FLOW},
{_MOTION},
    v AS (SELECT m, h, f, person_idx, round(px - gx, 6) + 0E0 AS vx, round(py - gy, 6) + 0E0 AS vy FROM p JOIN g USING (m, h, f)),
    b AS (SELECT m, h, f, 0 AS person_idx, 2 * (f % 3) AS x1, 2 * (f % 2) AS y1, 4 AS high FROM fr WHERE f % 5 <> 4 UNION ALL SELECT m, h, f, 1, 4 + 2 * (f % 4), 8, 6 FROM fr WHERE f % 5 <> 4),
    t AS (SELECT vec_id % 7 AS m, vec_id // 7 % 2 + 1 AS h, vec_id // 28 AS f, embedding[1]::DOUBLE AS first_logit FROM embeddings WHERE len(embedding) = 64 AND vec_id // 14 % 2 = 0)
    SELECT 'm' || fr.m AS match, fr.h::INT AS half, fr.f::INT AS frame_idx, b.person_idx, 0.5E0 + b.person_idx * 0.25E0 AS score, x1::DOUBLE AS x1, y1::DOUBLE AS y1, (x1 + 6)::DOUBLE AS x2, (y1 + high)::DOUBLE AS y2, vx, vy, CASE WHEN b.person_idx = 1 THEN first_logit END AS first_logit
    FROM fr LEFT JOIN b USING (m, h, f) LEFT JOIN v USING (m, h, f, person_idx) LEFT JOIN t USING (m, h, f)"""
)
def match_stages(spark, d):
    """Pictures and instances go through all stages by half: a first run over two matches is taken up by one over all of them."""
    from pitchgrid.plans import stages
    from pitchgrid.sources import manifest

    vectors, listing, counts = _written(spark, d)
    sizes, root = checkpointed(frame_counts(listing)), new_path(spark, "stages")
    people = _people(vectors).withColumns({"seg_idx": F.col("person_idx") * 2, "class_id": F.lit(0).cast("smallint"), "score": (0.5 + F.col("person_idx") * 0.25).cast("float")})
    ball = people.where("person_idx = 0").withColumns({"seg_idx": F.lit(1), "class_id": F.lit(32).cast("smallint")})
    teams = vectors.where("i % 2 = 0").selectExpr("match", "half", "cast(i div 2 as int) as frame_idx", "1 as person_idx", "cast(slice(embedding, 1, 5) as array<float>) as logits")
    whole = sizes.select("match", "half")
    for work in (whole.where("match in ('m0', 'm1')"), whole):
        stages.segmentation_stage(work, root, people.unionByName(ball))
        stages.velocity_stage(work, root, listing, counts, sizes, VelocityConfig(opening_size=1), with_overlays=False)
        manifest.run_stage(work, root, stages.TEAMS, lambda left: stages.of_halves(teams, left))
        stages.join_stage(work, root, sizes)
    out = stages.results(whole, root)
    velocity = [(F.round(c, 6) + 0.0).alias(c) for c in ("vx", "vy")]  # no negative zero
    return out.select("match", "half", "frame_idx", "person_idx", F.col("score").cast("double").alias("score"), "bbox.*", *velocity, F.get("logits", F.lit(0)).cast("double").alias("first_logit"))


@query(
    """WITH RECURSIVE c AS (SELECT o_orderkey // 128 AS y, o_orderkey % 128 AS x FROM orders WHERE o_custkey % 10 < 3),
    r AS (SELECT y, x, y * 2147483648 + x AS part FROM c
      UNION SELECT c.y, c.x, r.part FROM r, (SELECT a, b FROM range(-1, 2) p(a), range(-1, 2) q(b)) s JOIN c ON c.y = r.y + s.a AND c.x = r.x + s.b),
    m AS (SELECT y, x, min(part) AS part FROM r GROUP BY y, x)
    SELECT part::BIGINT AS part, count(*) AS n, min(y)::BIGINT AS y1, min(x)::BIGINT AS x1, max(y)::BIGINT AS y2, max(x)::BIGINT AS x2 FROM m GROUP BY part"""
)
def grid_parts(spark, d):
    """Connected parts of a grid of 128 columns that grows with the orders."""
    key = F.col("o_orderkey")
    cells = table(spark, d, "orders").where("o_custkey % 10 < 3").select(F.lit(0).alias("g"), F.expr("o_orderkey div 128").alias("y"), (key % 128).alias("x"))
    parts = connected_parts(cells, ["g"])
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.min("y").alias("y1"), F.min("x").alias("x1"), F.max("y").alias("y2"), F.max("x").alias("x2"))


def _mirror_sql(at: str) -> str:
    return f"least((({at}) % 16 + 16) % 16, 15 - (({at}) % 16 + 16) % 16)"


@query(
    f"""WITH w(k, w) AS (VALUES {", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in gaussian_weights(1.0))}),
    a AS (SELECT label AS g, p // 8 AS y, p % 8 AS x, avg(abs(embedding[p + 1]::DOUBLE)) AS v FROM embeddings, range(64) r(p) WHERE len(embedding) = 64 GROUP BY ALL)
    SELECT o.g, o.y::INT AS y, o.x::INT AS x, round(sum(wy.w * wx.w * a.v), 9) AS v FROM a o, w wy, w wx JOIN a ON a.g = o.g AND a.y = {_mirror_sql("o.y + wy.k")} AND a.x = {_mirror_sql("o.x + wx.k")} GROUP BY o.g, o.y, o.x"""
)
def smoothed_grid(spark, d):
    """The mean size of each label's vectors as an 8 by 8 picture, smoothed."""
    each = table(spark, d, "embeddings").where("size(embedding) = 64").select(F.col("label").alias("g"), F.posexplode("embedding").alias("p", "e"))
    cells = each.groupBy("g", F.expr("cast(p div 8 as int)").alias("y"), F.expr("cast(p % 8 as int)").alias("x")).agg(F.avg(F.abs(F.col("e").cast("double"))).alias("v"))
    smooth = gaussian_smooth(cells.withColumns({"height": F.lit(8), "width": F.lit(8)}), ["g"], ["v"], 1.0)
    return smooth.select("g", "y", "x", F.round("v", 9).alias("v"))


# labelled pictures: a vector's numbers are the 8 by 8 pixels of a picture in the folder of its label, green backwards, blue a mixture


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        e = np.array(batch["embedding"].to_pylist(), np.float32)
        red, green = _bytes(e), _bytes(e[:, ::-1])
        images = np.stack([red, green, (red // 2 + green // 4)], axis=-1)
        rows = [{"label": f"class-{r['label']}", "name": f"{r['vec_id']}.png", "data": png(x)} for r, x in zip(batch.select(["vec_id", "label"]).to_pylist(), images, strict=True)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("label", pa.string()), ("name", pa.string()), ("data", pa.binary())]))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    root = new_path(spark, "labelled")
    vectors = table(spark, d, "embeddings").where("size(embedding) = 64").select("vec_id", "label", "embedding")
    write_labelled(spread(vectors, FILES_PER_TASK).mapInArrow(_labelled, "label string, name string, data binary"), root)
    return list_labelled(spark, root)


def _weights_sql(name: str, source: int, target: int) -> str:
    w = resize_weights(source, target)
    return f"{name}(o, i, w) AS (VALUES {', '.join(f'({o}, {i}, {w[o, i]})' for o in range(target) for i in range(source) if w[o, i])})"


_RESIZED = f"""px AS (
  SELECT vec_id, label, k // 8 AS y, k % 8 AS x, unnest([0, 1, 2]) AS c, unnest([r, g, r // 2 + g // 4]) AS v
  FROM (SELECT vec_id, label, k, greatest(0, least(255, floor(128 + 100 * embedding[k + 1]::DOUBLE)))::INT AS r, greatest(0, least(255, floor(128 + 100 * embedding[64 - k]::DOUBLE)))::INT AS g
    FROM embeddings, range(64) t(k) WHERE len(embedding) = 64)),
{_weights_sql("w", 8, 6)},
hz AS (SELECT vec_id, label, y, o AS x, c, (sum(v * w)::BIGINT + {ONE // 2}) >> {BITS} AS v FROM px JOIN w ON x = i GROUP BY ALL),
rs AS (SELECT vec_id, label, o AS y, x, c, (sum(v * w)::BIGINT + {ONE // 2}) >> {BITS} AS v FROM hz JOIN w ON y = i GROUP BY ALL),
cat AS (SELECT label, row_number() OVER (ORDER BY 'class-' || label) - 1 AS category FROM (SELECT DISTINCT label FROM embeddings WHERE len(embedding) = 64))"""

_DIGEST = "sha256(string_agg(lower(printf('%02x', v::INT)), '' ORDER BY y, x, c))"


@query(
    f"""WITH {_RESIZED},
    dr AS (SELECT vec_id, label, copy, [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT for i in range(5)] AS d
      FROM (SELECT vec_id, label, copy, sha256('7/class-' || label || '/' || vec_id || '.png/' || copy) AS h FROM embeddings, range(3) t(copy) WHERE len(embedding) = 64)),
    cut AS (SELECT vec_id, label, copy, d, y - d[1] * 3 // 4294967296 AS y, CASE WHEN d[3] < 0.5E0 * 4294967296 THEN 3 - (x - d[2] * 3 // 4294967296) ELSE x - d[2] * 3 // 4294967296 END AS x, c, v
      FROM rs JOIN dr USING (vec_id, label) WHERE y - d[1] * 3 // 4294967296 BETWEEN 0 AND 3 AND x - d[2] * 3 // 4294967296 BETWEEN 0 AND 3),
    lohi AS (SELECT *, min(v) OVER p AS lo, max(v) OVER p AS hi FROM cut WINDOW p AS (PARTITION BY vec_id, copy, c)),
    st AS (SELECT * REPLACE (CASE WHEN d[4] < 0.2E0 * 4294967296 AND hi > lo THEN (v - lo) * 255 // (hi - lo) ELSE v END AS v) FROM lohi),
    grey AS (SELECT * REPLACE (CASE WHEN d[5] < 0.15E0 * 4294967296 THEN (sum(v * [19595, 38470, 7471][c + 1]) OVER (PARTITION BY vec_id, copy, y, x)::BIGINT + 32768) >> 16 ELSE v END AS v) FROM st)
    SELECT 'class-' || label AS label, vec_id || '.png' AS name, category::INT AS category, copy::INT AS copy, {_DIGEST} AS digest FROM grey JOIN cat USING (label) GROUP BY label, vec_id, category, copy"""
)
def augmented_pictures(spark, d):
    """Three training copies of each picture of a labelled folder, by a chain of 8 to 6 to 4 pixels."""
    made = training_pictures(_listed(spark, d), 3, 7, Recipe(resized=6, cropped=4))
    return made.select("label", "name", "category", "copy", F.sha2(F.lower(F.hex("pixels")).cast("binary"), 256).alias("digest"))


@query(f"WITH {_RESIZED} SELECT 'class-' || label AS label, vec_id || '.png' AS name, category::INT AS category, {_DIGEST} AS digest FROM rs JOIN cat USING (label) GROUP BY label, vec_id, category")
def evaluation_folder(spark, d):
    """The pictures of a labelled folder as a trained model sees them, 6 by 6."""
    return evaluation_pictures(_listed(spark, d), 6).select("label", "name", "category", F.sha2(F.lower(F.hex("pixels")).cast("binary"), 256).alias("digest"))
