"""Centroid clustering of vectors with ball-tree filtering.

Vectors become integers, so that sums, means and distances are exact and don't depend on the order of the rows. Each task
builds metric trees over its own vectors, ``TREE`` at a time: a node stores count, integer sum and the radius around its
mean. The trees are written once. In each round the centroids (a bounded number) go to the trees in the task's closure:

* a ball whose nearest centroid is nearer to each of its points than any other, by the triangle inequality, is assigned as a
  whole, by adding its count and sum;
* otherwise centroids that can't win are left out, and the ball's halves are looked at;
* a leaf's points are compared with the centroids that are left, in exact integers.

Only count and sum per tree and centroid leave a task; they are added up by a grouped sum. The last assignment walks the
same trees and gives every vector's centroid and exact distance.

Defined cases: vectors of another length, null ones and those with a null or non-finite component take no part; a component
beyond ``LIMIT`` in size after scaling counts as ``LIMIT`` (so distances fit 64 bits); with fewer vectors than centroids each
vector is one; rows with null ids come last as first centroids and are assigned like any other; repeated rows count as often
as they occur; ties go to the smaller number; an empty table gives an empty result; other columns have no effect. Sums beyond
64 bits show as the largest such number.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.storage import materialised

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
LIMIT = 1 << 27
#: Vectors of a tree and, at most, of a leaf.
TREE, LEAF = 8192, 32
#: Below this size products of integers are exact in doubles, which multiply faster.
EXACT = 1 << 22
TREES = "ids array<bigint>, points binary, first array<int>, last array<int>, left array<int>, right array<int>, radius array<double>, sums binary"


def build(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order, nodes) of a ball tree: node k holds the points first[k]:last[k] in that order; left and right are -1 at leaves."""
    order, nodes, todo = np.arange(len(points)), [], [(0, len(points), -1, 0)]
    while todo:
        first, last, parent, side = todo.pop()
        inside = points[order[first:last]].astype(np.float64)
        total = points[order[first:last]].sum(axis=0, dtype=np.int64)
        away = np.sqrt(((inside - total / (last - first)) ** 2).sum(axis=1))
        nodes.append([first, last, -1, -1, away.max(), total])
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes) - 1
        if last - first > LEAF and away.max() > 0:
            a = inside[away.argmax()]
            b = inside[((inside - a) ** 2).sum(axis=1).argmax()]
            half = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(inside @ (a - b), half)]
            todo += [(first, first + half, len(nodes) - 1, 0), (first + half, last, len(nodes) - 1, 1)]
    first, last, left, right, radius, sums = zip(*nodes, strict=True)
    return order, {"first": np.array(first), "last": np.array(last), "left": np.array(left), "right": np.array(right), "radius": np.array(radius), "sums": np.stack(sums)}


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to integer centroids."""
    kind = np.float64 if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    if kind is np.int64:  # differences stay within 64 bits where products of large components don't
        return np.stack([((p - x) ** 2).sum(axis=1) for x in c], axis=1)
    return ((p**2).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c**2).sum(axis=1)).astype(np.int64)


def walk(points: np.ndarray, t: dict[str, np.ndarray], centroids: np.ndarray) -> Iterator[tuple[str, int, np.ndarray]]:
    """Assignments ('ball', node, centroid) and ('leaf', node, centroids of its points) that cover each point once."""
    n = t["last"] - t["first"]
    centres = t["sums"] / n[:, None]
    alone = np.sort(np.unique(centroids, axis=0, return_index=True)[1])  # of equal centroids the smallest number wins
    z = centroids[alone].astype(np.float64)
    away = np.sqrt(np.maximum(((centres**2).sum(axis=1))[:, None] - 2 * centres @ z.T + (z**2).sum(axis=1), 0))
    # the error of a distance from products of large components is no more than this
    slack = 1e-6 * (1 + np.abs(centres).max(initial=0) + np.abs(z).max(initial=0))
    todo = [(0, np.arange(len(alone)))]
    while todo:
        k, open_ = todo.pop()
        d = away[k, open_]
        open_ = open_[d - t["radius"][k] <= d.min() + t["radius"][k] + slack]
        if len(open_) == 1:
            yield "ball", k, alone[open_[0]]
        elif t["left"][k] < 0:
            near = distances(points[t["first"][k] : t["last"][k]], centroids[alone[open_]])
            yield "leaf", k, alone[open_[near.argmin(axis=1)]]
        else:
            todo += [(t["left"][k], open_), (t["right"][k], open_)]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees over a task's vectors, a bounded number at a time."""

    def tree(rows: list[tuple]) -> pa.RecordBatch:
        points = np.stack([r[1] for r in rows])
        order, t = build(points)
        columns = {"ids": [rows[i][0] for i in order], "points": points[order].astype("<i4").tobytes()}
        columns |= {c: t[c].tolist() for c in ("first", "last", "left", "right", "radius")} | {"sums": t["sums"].astype("<i8").tobytes()}
        return pa.RecordBatch.from_pylist([columns], schema)

    ints = pa.list_(pa.int32())
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), *[(c, ints) for c in ("first", "last", "left", "right")], ("radius", pa.list_(pa.float64())), ("sums", pa.binary())])
    rows: list[tuple] = []
    for batch in batches:
        flat = np.asarray(batch["x"].flatten(), np.int64).reshape(-1, DIMS)
        rows += zip(batch["id"].to_pylist(), flat, strict=True)
        while len(rows) >= TREE:
            yield tree(rows[:TREE])
            rows = rows[TREE:]
    if rows:
        yield tree(rows)


def _opened(row: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    points = np.frombuffer(row["points"], "<i4").astype(np.int64).reshape(-1, DIMS)
    t = {c: np.array(row[c]) for c in ("first", "last", "left", "right", "radius")}
    return points, t | {"sums": np.frombuffer(row["sums"], "<i8").reshape(-1, DIMS)}


def _moments(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{centroid: (count, sum)} of the vectors nearest to it; as many rows as centroids reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMS), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                points, t = _opened(row)
                for kind, k, to in walk(points, t, centroids):
                    a, b = t["first"][k], t["last"][k]
                    if kind == "ball":
                        counts[to] += b - a
                        sums[to] += t["sums"][k]
                    else:
                        np.add.at(counts, to, 1)
                        np.add.at(sums, to, points[a:b])
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_pydict({"c": pa.array(some, pa.int32()), "n": pa.array(counts[some]), "s": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})

    each = trees.mapInArrow(partial, "c int, n bigint, s array<bigint>")
    wide = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIMS)]
    return {r.c: (int(r.n), [int(r[f"s{i}"]) for i in range(DIMS)]) for r in each.groupBy("c").agg(F.sum("n").alias("n"), *wide).collect()}


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                points, t = _opened(row)
                cluster = np.zeros(len(points), np.int64)
                for _, k, to in walk(points, t, centroids):
                    cluster[t["first"][k] : t["last"][k]] = to
                far = ((points - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_pydict({"id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(far, pa.int64())})

    return trees.mapInArrow(final, "id bigint, cluster int, distance bigint")


def integer_vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x) of the vectors that take part, x in integers."""
    v = F.col(vector)
    whole = v.isNotNull() & (F.size(v) == DIMS) & F.forall(v, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    scaled = F.transform(v, lambda y: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(y.cast("double") * SCALE).cast("double"))).cast("int"))
    return rows.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), scaled.alias("x"))


def cluster(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every vector, centroids) after so many rounds from the k vectors with the smallest hashes."""
    vectors = integer_vectors(rows, id_col, vector)
    key = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(key.asc_nulls_last(), "x").limit(k).collect()  # a bounded number
    trees = materialised(vectors.mapInArrow(_trees, TREES))
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, DIMS)
    for _ in range(rounds if len(first) else 0):
        for c, (n, total) in _moments(trees, centroids).items():
            centroids[c] = [s // n for s in total]
    return _assigned(trees, centroids), centroids


def cluster_digests(rows: DataFrame) -> DataFrame:
    """The query's columns of every vector: its cluster, distances and the digest of its centroid."""
    assigned, centroids = cluster(rows)
    assigned = materialised(assigned)
    spark = rows.sparkSession
    names = [(i, sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(2**63 - 1)).cast("bigint")
    sums = assigned.groupBy("cluster").agg(total("distance").alias("cluster_inertia"))
    # one row a centroid, of which there are k at most
    sums = sums.join(spark.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster")
    whole = sums.agg(total("cluster_inertia").alias("inertia"))
    out = assigned.join(F.broadcast(sums.crossJoin(whole)), "cluster")
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    """SQL of assignment a{i} to the centroids c{i}, and of the centroids of the next round."""
    floored = "(s - ((s % n) + n) % n) // n"
    return f"""
d{i} AS MATERIALIZED (SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c USING (k) GROUP BY v.vec_id, c.c),
a{i} AS MATERIALIZED (SELECT vec_id, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM d{i} GROUP BY vec_id),
m{i} AS (SELECT a.c, v.k, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{i} a JOIN v USING (vec_id) GROUP BY a.c, v.k),
c{i + 1} AS MATERIALIZED (SELECT c.c, c.k, CASE WHEN n IS NULL THEN c.x ELSE {floored} END AS x FROM c{i} c LEFT JOIN m{i} USING (c, k))"""


ORACLE_SQL = f"""
WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMS} AND list_count(embedding) = {DIMS} AND len(list_filter(embedding, lambda y: isfinite(y))) = {DIMS}),
v AS MATERIALIZED (SELECT vec_id, k, floor({SCALE} * embedding[k]::DOUBLE)::BIGINT AS x FROM kept, range(1, {DIMS + 1}) t(k)),
c0 AS MATERIALIZED (SELECT f.c, v.k, v.x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM kept) f JOIN v USING (vec_id) WHERE f.c < {CENTROIDS}),
{",".join(_round(i) for i in range(ROUNDS + 1))},
i AS (SELECT c, sum(d) AS cluster_inertia FROM a{ROUNDS} GROUP BY c),
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY k)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, i.cluster_inertia::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a{ROUNDS} a JOIN i ON i.c = a.c JOIN h ON h.c = a.c
"""
