"""The window search in rounds against one that tries every window of a half in order."""

from pathlib import Path

import numpy as np
import pytest

from pitchgrid.operators import alignment
from pitchgrid.sources import shared

SCHEMA = "match string, frame_idx int, bbox struct<x1:double,y1:double,x2:double,y2:double>"


def overlap(p, q):
    wide, high = min(p[2], q[2]) - max(p[0], q[0]) + 1, min(p[3], q[3]) - max(p[1], q[1]) + 1
    shared = max(wide, 0) * max(high, 0)
    return shared / ((p[2] - p[0] + 1) * (p[3] - p[1] + 1) + (q[2] - q[0] + 1) * (q[3] - q[1] + 1) - shared)


def mean_best(a, b):
    if not len(a) or not len(b):
        return -1.0
    if len(a) > len(b):
        a, b = b, a
    return round(float(np.mean([max(overlap(p, q) for q in b) for p in a])), 9)


def brute(detected, video):
    n, step, out = len(video), 2 * len(video) // len(detected), []
    low, high = 0, min(step, n)
    for boxes in detected:
        if not len(boxes):
            out.append((low + step // 2, 3.0))
            high = min(low + 10 * step, n)
            continue
        seen = {}
        for k in range(30):
            a, b = max(low - k * (step // 2), 0), min(high + k * (step // 2), n)
            if b - a <= len(seen) or low >= high:
                break
            seen |= {i: mean_best(boxes, video[i]) for i in range(a, b) if i not in seen}
            if max(seen.values()) >= 0.5:
                break
        best = max(seen.values(), default=-1.0)
        at = next((i for i, s in seen.items() if s == best), -1)
        out.append((at, round(best, 6)))
        low, high = max(at + step // 4, 0), min(at + -(-4 * step // 5), n)
    return out


def random_boxes(rng, n):
    corner = rng.integers(0, 40, (n, 2))
    return np.hstack([corner, corner + rng.integers(5, 30, (n, 2))]).astype(float).tolist()


def halves(seed, n, longest):
    rng = np.random.default_rng(seed)
    out = {}
    for k in range(n):
        video = [random_boxes(rng, rng.integers(0, 4)) for _ in range(rng.integers(1, longest))] + [random_boxes(rng, 1)]
        detected = [random_boxes(rng, rng.integers(0, 4)) if rng.random() < 0.5 else video[rng.integers(len(video))] for _ in range(rng.integers(0, longest // 2))]
        out[None if k == 0 else f"m{k}"] = ([*detected, random_boxes(rng, 2)], video)
    return out


def tables(spark, cases):
    rows = [[(m, f, tuple(b)) for m, case in cases.items() for f, boxes in enumerate(case[side]) for b in boxes] for side in (0, 1)]
    return [spark.createDataFrame(r, SCHEMA) for r in rows]


def found(spark, cases):
    got = {}
    for r in alignment.align(*tables(spark, cases), ["match"]).collect():
        got.setdefault(r.match, {})[r.frame_idx] = (r.all_frame_idx, r.mean_iou)
    return got


@pytest.mark.parametrize("budget,longest", [(alignment.BUDGET, 60), (2, 30)])
def test_rounds_equal_a_search_of_all_windows(spark, monkeypatch, budget, longest):
    monkeypatch.setattr(alignment, "BUDGET", budget)
    cases = halves(9, 24, longest)
    assert found(spark, cases) == {m: dict(enumerate(brute(*case))) for m, case in cases.items()}


def test_a_shifted_half_is_found_in_one_round(spark, monkeypatch):
    rng = np.random.default_rng(3)
    video = [np.hstack([p := rng.uniform(0, 400, (6, 2)), p + 40]).tolist() for _ in range(400)]
    detected = [video[2 * i] for i in range(200)]
    for i in (5, 90, 91, 92, 150):
        detected[i] = []
    calls = []
    inner = alignment._rounds
    monkeypatch.setattr(alignment, "_rounds", lambda states: calls.append(1) or inner(states))
    got = found(spark, {"a": (detected, video)})["a"]
    assert got == dict(enumerate(brute(detected, video)))
    assert {i for i in range(200) if got[i][0] != 2 * i} <= {5, 90, 91, 92, 150}
    assert len(calls) == 1


def test_defined_cases(spark):
    d = spark.createDataFrame([("a", 0, (0.0, 0.0, 9.0, 9.0)), ("a", 2, (0.0, 0.0, None, 9.0)), ("a", -1, (0.0, 0.0, 9.0, 9.0)), ("a", None, (0.0, 0.0, 9.0, 9.0)), ("b", 0, None), ("c", 0, (0.0, 0.0, 9.0, 9.0)), ("c", 0, (0.0, 0.0, 9.0, 9.0))], SCHEMA)
    v = spark.createDataFrame([("a", 1, (0.0, 0.0, 9.0, 9.0)), ("c", 0, (0.0, 0.0, 9.0, 9.0)), ("d", 0, (0.0, 0.0, 9.0, 9.0))], SCHEMA)
    got = {(r.match, r.frame_idx): (r.all_frame_idx, r.mean_iou) for r in alignment.align(d, v, ["match"]).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0)} and got["b", 0] == (0, 3.0) and got["c", 0] == (0, 1.0)
    assert [got[("a", k)] for k in range(3)] == brute([[(0.0, 0.0, 9.0, 9.0)], [], []], [[], [(0.0, 0.0, 9.0, 9.0)]])
    assert alignment.align(d.where("false"), v, ["match"]).collect() == []
    none = alignment.align(d.where("match = 'c'"), v.where("false"), ["match"]).collect()
    assert [tuple(r) for r in none] == [("c", 0, -1, -1.0)]


def test_bands_join_by_tile(spark):
    d, v = (alignment.boxes_by_frame(t, ["match"]) for t in tables(spark, halves(1, 3, 20)))
    bands = d.selectExpr("half_id", "frame_idx", "boxes", "0L as first", "20L as beyond")
    plan = alignment.band_scores(bands, v)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "RepartitionByExpression [half_id" in plan and "tile" in plan.split("RepartitionByExpression")[1][:40]


def test_unrelated_short_halves_need_one_round(spark, monkeypatch):
    calls = []
    inner = alignment._rounds
    monkeypatch.setattr(alignment, "_rounds", lambda states: calls.append(1) or inner(states))
    cases = halves(4, 6, 60)
    assert found(spark, cases) == {m: dict(enumerate(brute(*case))) for m, case in cases.items()}
    assert len(calls) == 1


def test_pairs_of_boxes_are_no_rows(spark):
    d, v = (alignment.boxes_by_frame(t, ["match"]) for t in tables(spark, halves(1, 3, 20)))
    bands = d.selectExpr("half_id", "frame_idx", "boxes", "0L as first", "20L as beyond")
    plan = alignment.band_scores(bands, v)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and "boxes" not in plan.split("Generate")[1].split("\n")[0]
    sides = {s: {(r.half_id, r.frame_idx): [tuple(b) for b in r.boxes] for r in t.collect()} for s, t in (("d", d), ("v", v))}
    want = {(h, f, g): mean_best(a, b) for (h, f), a in sides["d"].items() for (k, g), b in sides["v"].items() if h == k and g < 20 and a and b}
    assert {(r.half_id, r.frame_idx, r.video_idx): r.score for r in alignment.band_scores(bands, v).collect()} == want


def test_small_halves_are_scored_where_they_are_folded(spark, monkeypatch):
    """No score of theirs is shuffled or written."""
    monkeypatch.setattr(alignment, "_tile_scores", lambda *_: pytest.fail("scores are shuffled"))
    cases = halves(4, 6, 60)
    assert found(spark, cases) == {m: dict(enumerate(brute(*case))) for m, case in cases.items()}


@pytest.mark.parametrize("whole,cells", [(0, alignment.CELLS), (60, alignment.CELLS), (alignment.WHOLE, 1)])
def test_halves_of_any_size_get_the_same_rows(spark, monkeypatch, whole, cells):
    monkeypatch.setattr(alignment, "WHOLE", whole)
    monkeypatch.setattr(alignment, "CELLS", cells)
    tables, inner = [], alignment.stored
    monkeypatch.setattr(alignment, "stored", lambda df: tables.append(inner(df)) or tables[-1])
    gone = []
    monkeypatch.setattr(alignment, "discard", lambda *t: gone.extend(t))
    cases = halves(9, 12, 40)
    assert found(spark, cases) == {m: dict(enumerate(brute(*case))) for m, case in cases.items()}
    assert tables and {id(t) for t in tables} == {id(t) for t in gone}


def test_stored_tables_can_be_deleted(spark):
    table = shared.stored(spark.range(5))
    folder = Path(table.inputFiles()[0].removeprefix("file:")).parent
    assert table.count() == 5 and folder.exists()
    shared.discard(table, spark.range(3))
    assert not folder.exists()
