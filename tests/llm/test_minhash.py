import random

import numpy as np
import pytest

from pitchgrid.llm import minhash as M

SCHEMA = "doc_id long, text string"


def sets_of(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "?").split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    """{(doc_id, n_shingles, component_id, kept)} by comparing all pairs; rows with one id share a node."""
    parent, sets = {d: d for d, _ in rows if d is not None}, [(d, sets_of(t)) for d, t in rows]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if d is not None and e is not None and a and b and 100 * len(a & b) >= 80 * len(a | b) and root(d) != root(e):
                low, high = sorted((root(d), root(e)))
                parent[high] = low
    return sorted(((d, len(s), d if not s or d is None else root(d), None if d is None else not s or d == root(d)) for d, s in sets), key=repr)


def got(spark, rows):
    return sorted((tuple(r) for r in M.minhash_classes(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def edited(n, seed=5):
    """Texts of 1 to 200 words with chains of copies that have 0 to 6 changed words, and a passage in common."""
    rng, common = random.Random(seed), [f"common{i}" for i in range(40)]
    out = []
    for base in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((1, 3, 4, 5, 6, 9, 20, 60, 200)))] + common * (base % 2)
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            out.append(" ".join(copy))
            words = copy if rng.random() < 0.5 else words
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("stars,block", [(M.STARS, M.BLOCK), (1, 3)])
def test_every_link_is_found(spark, monkeypatch, stars, block):
    monkeypatch.setattr(M, "STARS", stars)
    monkeypatch.setattr(M, "BLOCK", block)
    texts = [None, "", " \t\n", "one", "ONE", "One two", "a b c d", "A  b\tC d", "ä b c d", "Ä b c d", *edited(30)]
    rows = list(enumerate(texts))
    assert got(spark, rows) == brute(rows)


def test_driver_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, rows) == brute(rows)


def test_a_large_group_and_a_centre_unlike_its_bucket(spark):
    """Copies that differ from each other by more than from their common text, and others that hold the text as a part."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base + [f"y{i}_{j}" for j in range(60)])) for i in range(60)] + [(5000, " ".join(base))]
    assert got(spark, rows) == brute(rows)


def test_null_ids_shared_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (9, "a b c d e"), (9, "x y z u v"), (11, "x y z u v"), (12, None), (None, None)]
    found = got(spark, rows)
    assert [r for r in found if r[0] is not None] == sorted([(2, 2, 2, True), (2, 2, 2, True), (9, 2, 2, False), (9, 2, 2, False), (11, 2, 2, False), (12, 0, 12, True)], key=repr)
    assert [r for r in found if r[0] is None] == [(None, 0, None, None), (None, 2, None, None)]
    assert got(spark, []) == []


def test_long_text_and_clashing_columns(spark):
    words = [f"w{i % 5003} v{i}" for i in range(100_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:99_000], "other"])), (3, "short text of its own")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "'f' as fp", "array(1L) as keys", "'t' as t", "2 as component_id")
    found = sorted((r.doc_id, r.component_id) for r in M.minhash_classes(docs).collect())
    assert found == [(1, 1), (2, 1), (3, 3)]


def test_bins_agree_with_the_similarity():
    """Densified bins of few shingles agree as often as the sets are similar."""
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(300):
        a = rng.integers(-(2**63), 2**63, 6, dtype=np.int64)
        agree.append((M.sketch(np.sort(a)) == M.sketch(np.sort(a[:5]))).mean())
    assert abs(np.mean(agree) - 5 / 6) < 0.02
    one = np.array([7], np.int64)
    assert (M.sketch(one) == 7).all() and len(set(M.band_keys(one))) == M.BANDS
