import math
import random
from hashlib import sha256

import numpy as np
import pytest

from pitchgrid.llm import ball_trees as B

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=40, rounds=5):
    """Rows of the query, by plain integers and all distances."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, tuple(max(-B.LIMIT, min(B.LIMIT, x)) for x in v)) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, j) in zip(kept, nearest(), strict=True):
            groups.setdefault(j, []).append(v)
        for j, g in groups.items():
            centroids[j] = tuple(sum(x) // len(g) for x in zip(*g, strict=True))
    found, top = nearest(), 2**63 - 1
    inertia = {j: sum(d for d, i in found if i == j) for _, j in found}
    name = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, min(top, inertia[j]), min(top, sum(inertia.values())), name[j]) for (i, _), (d, j) in zip(kept, found, strict=True)), key=repr)


def clustered(n, spread, seed=3):
    """Vectors around 50 centres; small spreads make balls that go to one centroid as a whole."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(50, 64))
    return [(i, (centres[i % 50] + rng.normal(size=64) * spread).astype(np.float32).tolist()) for i in range(n)]


def got(spark, rows):
    return sorted((tuple(r) for r in B.cluster_digests(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=repr)


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_equals_brute_force(spark, spread):
    rows = clustered(400, spread)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = clustered(60, 0.3)
    rows += [(None, rows[0][1]), (None, rows[1][1]), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [math.nan]), (905, [math.inf] * 64)]
    rows += [(906, [3e38] * 64), (907, [-3e38] + [5e5] * 63), (908, [0.0] * 64), (909, [0.0] * 64)]
    assert got(spark, rows) == brute(rows)


def test_copies_fewer_vectors_than_centroids_and_empty_table(spark):
    same = [(i, [0.5] * 64) for i in range(100)]
    assert got(spark, same) == brute(same)
    few = clustered(5, 1.0)
    assert got(spark, few) == brute(few)
    assert got(spark, []) == []


def test_whole_balls_are_assigned_and_every_point_once():
    rng = random.Random(1)
    points = np.array([[c * 400 + rng.randrange(20) for _ in range(64)] for c in range(4) for _ in range(200)], np.int64)
    order, t = B.build(points)
    points = points[order]
    centroids = np.array([[c * 400 + 10] * 64 for c in range(4)] + [[10] * 64], np.int64)
    out, kinds = np.full(len(points), -1), []
    for kind, k, to in B.walk(points, t, centroids):
        assert (out[t["first"][k] : t["last"][k]] == -1).all()
        out[t["first"][k] : t["last"][k]] = to
        kinds.append(kind)
    assert (out == B.distances(points, centroids).argmin(axis=1)).all() and "ball" in kinds
    n = t["last"] - t["first"]
    assert n[0] == len(points) and (t["sums"][0] == points.sum(axis=0)).all()


def test_trees_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(B, "TREE", 16)
    monkeypatch.setattr(B, "LEAF", 2)
    rows = clustered(120, 0.2)
    assert got(spark, rows) == brute(rows)
