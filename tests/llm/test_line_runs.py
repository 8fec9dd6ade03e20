import random

import pytest

import corpus_pipeline
from pitchgrid.llm import line_dedup as L
from tests.llm.test_line_dedup import BLOCK, TEXTS

SCHEMA = "doc_id long, text string"


def brute(rows):
    """{doc_id: (text, n_removed_lines)} by trying every run of lines, of any length, against all earlier ones."""
    first, out = {}, {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 2, len(lines) + 1):
                run = "\n".join(lines[a:b])
                if len(run) >= L.MIN_CHARS:
                    d, at = first.setdefault(run, (doc, a))
                    if d != doc or at + b - a <= a:
                        gone |= set(range(a, b))
        out[doc] = ("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text, len(gone))
    return out


def planted(n):
    """Documents of own lines with passages of 2 to 5 lines of a common pool, lines long and short."""
    rng = random.Random(3)
    pool = [[f"p{p} line {i} " + "é" * rng.choice([0, 3, 20, 60]) for i in range(rng.randrange(2, 6))] for p in range(12)]
    for doc in range(n):
        lines = []
        for part in range(rng.randrange(1, 5)):
            lines += [f"own {doc} {part} {i}" for i in range(rng.randrange(3))] + rng.choice(pool)
        yield doc, "\n".join(lines)


@pytest.mark.parametrize("limit", [L.MAX_BROADCAST_ROWS, 0])
def test_every_repeated_run_goes(spark, limit):
    rows = list(planted(60)) + [(100 + i, t) for i, t in enumerate(TEXTS) if t is not None]
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in L.run_dedup(spark.createDataFrame(rows, SCHEMA), max_broadcast_rows=limit).collect()}
    assert got == brute(rows)


def test_content_defined_chunks_go_first(spark, monkeypatch):
    """Repeated chunks go by the rolling hash; runs are searched around them, and their rows are the same as without."""
    rows = [(i, f"own {i}\n{BLOCK}\nend {i}") for i in range(4)] + [(10 + i, f"{BLOCK}\nown {i}\n{BLOCK}") for i in range(2)]
    texts, searched, inner = dict(rows), [], L._repeats
    monkeypatch.setattr(L, "_repeats", lambda hashes, *a: searched.append([tuple(r) for r in hashes.select("id", "at").collect()]) or inner(hashes, *a))
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in L.run_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    chunks, runs = searched
    assert {k for d, k in chunks if d == 0} <= set(range(len(L.chunk_ends(texts[0].encode().split(b"\n")))))
    every = {d: len(L.shortest_runs(t.encode().split(b"\n"))) for d, t in rows}
    some = {d: sum(e == d for e, _ in runs) for d in texts}
    assert some[0] == every[0] and all(some[d] < every[d] for d in texts if d)


def test_stage_removes_two_line_passages(spark):
    passage = "the first line of a passage that many documents share\nand the second line of the same passage, no more"
    rows = [(i, f"before {i}\n{passage}\nafter {i}") for i in range(3)]
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {0: rows[0][1], 1: "before 1\nafter 1", 2: "before 2\nafter 2"}


def test_null_texts_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(1, None), (None, BLOCK), (5, BLOCK), (5, BLOCK)]
    got = sorted((str(r.doc_id), r.text is None, r.n_removed_lines) for r in L.run_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", True, 0), ("5", False, 0), ("5", False, 0), ("None", False, 12)]
    assert L.run_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
