from collections import Counter

import pytest

from pitchgrid.llm import line_dedup as L

BLOCK = "\n".join(f"shared line number {i} with some words in it" for i in range(12))
TEXTS = [
    None,
    "",
    "one line",
    BLOCK,
    "an inserted line\n" + BLOCK + "\nand a tail",
    BLOCK + "\n" + BLOCK,
    "\n\n\n\n\n\n",
    "\n\n\n\n\n\n",
    "x\n" * 200 + BLOCK,
]
SCHEMA = "doc_id long, text string, h int, at string, n_lines string"


def brute(rows):
    """(doc_id, text, n_removed_lines) of rows (doc_id, text), by direct comparison of chunk bytes."""
    chunks, first = [], {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = text.encode().split(b"\n")
        ends = L.chunk_ends(lines)
        own = [lines[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        gone = []
        for k, c in enumerate(own):
            chunk = b"\n".join(c)
            if len(c) > 1 and len(chunk.decode()) >= L.MIN_CHARS and first.setdefault(chunk, (doc, k)) != (doc, k):
                gone.append(k)
        kept = b"\n".join(x for k, c in enumerate(own) if k not in gone for x in c).decode() if gone else text
        chunks.append((doc, kept, sum(len(own[k]) for k in gone)))
    return chunks


@pytest.mark.parametrize("limit", [L.MAX_BROADCAST_ROWS, 0])
def test_equals_brute_force(spark, limit):
    rows = [(i, t, 1, "a", "b") for i, t in enumerate(TEXTS)]
    out = L.line_dedup(spark.createDataFrame(rows, SCHEMA), max_broadcast_rows=limit)
    assert out.columns == ["doc_id", "text", "h", "at", *L.RESULTS]
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in out.collect()}
    assert got[0] == (None, 0)
    assert [(d, *got[d]) for d in range(1, len(TEXTS))] == brute(list(enumerate(TEXTS))[1:])
    assert got[4][1] > 0 and got[3][1] == 0


def test_boundaries_resist_shifts():
    lines = BLOCK.encode().split(b"\n")
    a, b = L.chunk_ends(lines), L.chunk_ends([b"new", b"lines", *lines])
    inner = [e for e in a if L.WINDOW <= e < len(lines)]
    assert inner and all(e + 2 in b for e in inner)


def test_colliding_hashes_are_told_apart_by_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, 7, 0, 5, "aa"), (2, 7, 0, 5, "bb"), (3, 7, 0, 5, "bb")], "id long, key long, at int, h long, chunk string")
    gone = L._removed(docs.drop("chunk"), docs, L.MAX_BROADCAST_ROWS).collect()
    assert [(r.id, r.ats) for r in gone] == [(3, [0])]


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(None, BLOCK, 1, "", ""), (5, BLOCK, 1, "", ""), (5, BLOCK, 1, "", "")]
    got = Counter((r.doc_id, r.n_removed_lines > 0) for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == {(None, True): 1, (5, False): 2}
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
