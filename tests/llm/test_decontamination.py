import re

import pytest

from pitchgrid.llm import decontamination as D

DOCS = "doc_id long, text string, h int, item_id string, w string"
ITEMS = "item_id long, text string, shingle string, length int"
PASSAGE = " ".join(f"Item{i}" for i in range(30))


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)} if words else set()


def windows(text, n):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            s = shingles(item)
            if d is None or i is None or not s:
                continue
            n = len(s & windows(text, len(next(iter(s)).split(" "))))
            if n >= 0.8 * len(s) - 1e-9:
                out.add((d, i, n, len(s)))
    return out


ITEM_ROWS = [(1, PASSAGE), (2, "just three words"), (3, None), (4, "  "), (5, "the same the same the same the same the same the same"), (6, "short"), (None, PASSAGE)]
DOC_ROWS = [
    (1, "before " + PASSAGE.upper() + " after"), (2, " ".join(PASSAGE.split()[:27])), (3, " ".join(PASSAGE.split()[:20])), (4, None), (5, ""),
    (6, "It has just\tthree\nwords and is SHORT"), (7, ("filler " * 900) + PASSAGE), (8, "the same the same the same"), (9, PASSAGE.replace("Item15", "Changed")), (None, PASSAGE),
]


@pytest.mark.parametrize("limit", [D.MAX_BROADCAST_ROWS, 0])
def test_equals_brute_force(spark, limit):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in DOC_ROWS] + [(1, DOC_ROWS[0][1], 1, "x", "y")], DOCS)
    items = spark.createDataFrame([(*r, "s", 9) for r in ITEM_ROWS] + [(6, "short", "s", 9)], ITEMS)
    got = D.contaminated(docs, items, max_broadcast_rows=limit).collect()
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == brute(DOC_ROWS, ITEM_ROWS) and len(got) == len(brute(DOC_ROWS, ITEM_ROWS))
    assert {r.doc_id for r in got} >= {1, 2, 6, 7}
    kept = D.decontaminate(docs, items, max_broadcast_rows=limit)
    assert kept.columns == docs.columns
    # rows are judged by their own text, with a null id too
    leaks = {d for d, *_ in brute(list(enumerate(r[1] for r in DOC_ROWS)), ITEM_ROWS)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for i, r in enumerate(DOC_ROWS) if i not in leaks)


def test_rows_of_one_id_do_not_convict_each_other(spark):
    words = PASSAGE.split()
    halves = [" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])]
    docs = spark.createDataFrame([(1, t, 0, "z", "z") for t in [*halves, PASSAGE]], DOCS)
    kept = D.decontaminate(docs, spark.createDataFrame([(1, PASSAGE, "s", 9)], ITEMS)).collect()
    assert sorted(r.text for r in kept) == sorted(halves)


def test_every_scattered_subset_is_found(spark):
    """However the shingles that a document may miss are chosen, a sketched one is left."""
    items = spark.createDataFrame([(1, PASSAGE, "s", 9)], ITEMS)
    words = PASSAGE.split()
    texts = [(i, " ".join(words[:i] + ["gap"] + words[i + 1 :])) for i in range(len(words))]
    got = {r.doc_id for r in D.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()}
    assert got == {d for d, *_ in brute(texts, [(1, PASSAGE)])}


def test_empty_tables_and_no_python(spark, capsys):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert D.contaminated(docs, items).count() == 0
    full = spark.createDataFrame([(*r, 1, "x", "y") for r in DOC_ROWS], DOCS)
    assert D.contaminated(full, items).count() == 0
    assert D.contaminated(docs, spark.createDataFrame([(1, PASSAGE, "s", 9)], ITEMS)).count() == 0
    D.contaminated(full, spark.createDataFrame([(1, PASSAGE, "s", 9)], ITEMS)).explain()
    assert "Python" not in capsys.readouterr().out
