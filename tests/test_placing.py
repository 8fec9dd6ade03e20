"""Places, numbers, splits and medians of groups of any size: the large-group ways against plain Python."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pitchgrid.operators import aggregation, ranking
from pitchgrid.operators.placing import placed


def skewed(n):
    rng = random.Random(3)
    return [("hot" if i % 10 else rng.choice(["a", "b", None]), rng.randrange(n) if i % 7 else None, i) for i in range(n)]


@pytest.mark.parametrize("window_rows", [0, None])
def test_places(spark, window_rows):
    rows = skewed(500) + [("hot", 5, 5)] * 40 + [("one", 1, 1)]
    got = placed(spark.createDataFrame(rows, "g string, v int, id int").repartition(5), ["g"], ["v", "id"], window_rows).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    want = []
    for g in groups.values():
        g.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want += [(*r, k, len(g)) for k, r in enumerate(g)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    empty = spark.createDataFrame([], "g string, v int, id int")
    assert placed(empty, ["g"], ["v"], window_rows).count() == 0


def test_split_and_numbers_are_the_same_either_way(spark):
    rows = spark.createDataFrame(skewed(400), "category string, v int, id int").repartition(4)
    for f in (lambda w: ranking.stratified_split(rows, "category", "id", 0.1, w), lambda w: ranking.number_within(rows, ["category"], ["id"], window_rows=w)):
        assert sorted(map(repr, f(0).collect())) == sorted(map(repr, f(None).collect()))
    plan = ranking.stratified_split(rows, "category", "id", 0.1, 0)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__k" in line for line in windows)  # only counts by range are windowed


@pytest.mark.parametrize("heap_rows", [0, 10**6])
def test_medians_of_skewed_groups(spark, heap_rows):
    rng = random.Random(1)
    values = {"all": [rng.gauss(0, 1) for _ in range(3001)], "even": [rng.random() for _ in range(100)], "same": [0.25] * 50, "one": [7.0], "two": [1.0, 2.0]}
    values["far"] = [1e-300, 1e300, -1e300, 0.0, 5.0, 5.0, 1e-5]
    values["ties"] = [float(rng.randrange(3)) for _ in range(201)]
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("one", None)]
    got = {r.g: r.m for r in aggregation.exact_medians(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", heap_rows).collect()}
    assert got == pytest.approx({g: statistics.median(v) for g, v in values.items()}, rel=1e-12)


def test_class_medians_by_selection_equal_those_of_one_task(spark):
    rng = random.Random(2)
    rows = [(0 if i % 20 else 1, [rng.random() for _ in range(3)]) for i in range(800)]
    members = spark.createDataFrame(rows, "category int, hist array<double>")
    a, b = ({r.category: r["median"] for r in aggregation.class_medians(members, h).collect()} for h in (0, 10**6))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)
    assert aggregation.class_medians(members.limit(0), 0).count() == 0
