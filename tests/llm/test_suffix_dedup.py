import hashlib
import random

import numpy as np
import pytest

from pitchgrid.llm import suffix_dedup as S

WINDOW = S.WINDOW


def brute_force(texts: list[bytes], window: int = S.WINDOW) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by a table of all windows."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        left = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        runs = int((gone[1:] < gone[:-1]).sum())
        out.append((len(t), len(t) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return out


RNG = random.Random(3)
LONG = "".join(RNG.choice("abcdef é") for _ in range(900))
TEXTS = [
    "a" * 450, "x" + LONG, LONG[100:500] + "y" + LONG[501:900], "ab" * 101, None, "", LONG[:199], LONG[300:499], "é" * 150,
    LONG[10:260], "q" * 199 + "r" + "q" * 199,
]
SCHEMA = "doc_id long, text string, id int, c string, kept string"


def result(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"batches": 3, "limit": 0}, {"window": 40}])
def test_equals_brute_force_with_ties_nulls_repeated_ids_and_clashing_names(spark, options):
    rows = [(i if i != 9 else None, t, 1, "z", "k") for i, t in enumerate(TEXTS)]
    rows += [(0, TEXTS[0], 2, "w", None), (1, "other " + TEXTS[2], 2, "w", None)]
    deduped = S.suffix_dedup(spark.createDataFrame(rows, SCHEMA), **options)
    assert deduped.columns == ["doc_id", "id", "c", *S.RESULTS]
    want = brute_force([(r[1] or "").encode() for r in rows], options.get("window", S.WINDOW))
    assert result(S.dedup_digests(deduped)) == sorted((str(r[0]), *x) for r, x in zip(rows, want, strict=True))


def test_empty_table(spark):
    assert S.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = brute_force([r.text.encode() for r in rows])
    got = result(S.dedup_digests(S.suffix_dedup(docs)))
    assert got == sorted((str(r.doc_id), *x) for r, x in zip(rows, want, strict=True))


def test_levels_merge_geometrically_and_report_what_a_batch_repeats(spark):
    rng, index, seen, ranks = random.Random(6), S.SuffixIndex(), {}, []
    for _ in range(7):
        batch = [(rng.randrange(9), rng.randrange(9)) for _ in range(12)] + [(100, -1)]
        got = {tuple(r) for r in index.add(spark.createDataFrame(batch, "s1 long, s2 long")).collect()}
        once = {k for k, n in seen.items() if n == 1} | (set(batch) - seen.keys())
        for k in batch:
            seen[k] = seen.get(k, 0) + 1
        assert {k for k in once if seen[k] > 1} <= got <= {k for k in seen if seen[k] > 1}
        ranks.append([rank for rank, _ in index.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]
    stored = {}
    for _, level in index.levels:
        rows = [tuple(r) for r in level.collect()]
        for x, y, n in rows:
            stored[x, y] = stored.get((x, y), 0) + n
    assert stored == seen


def test_a_stored_index_takes_a_later_batch(spark):
    def suffixes(*texts):
        rows = spark.createDataFrame([(i, 0, t, None) for i, t in enumerate(texts)], S.T.StructType().add("id", "long").add("x", "long").add("text", "string").add("spans", S.SPANS))
        return S._unit_rows(rows, 64, WINDOW)

    first = S.SuffixIndex()
    assert first.add(suffixes(LONG)).count() == 0
    later = S.SuffixIndex(first.levels)
    assert later.add(suffixes("other " * 40 + LONG[200:600])).count() > 0
    assert [rank for rank, _ in later.levels] == [1]
    assert later.add(suffixes("".join(RNG.choice("ghijkl") for _ in range(500)))).count() == 0


def test_levels_are_in_the_order_of_the_suffixes_bytes(spark):
    text = LONG.encode()
    for start, _, _, lo, _ in S.units(text, S.WINDOW):
        at = sorted(range(len(lo)), key=lambda i: text[lo[i] : lo[i] + S.PREFIX])
        assert sorted(map(tuple, start.tolist())) == [tuple(start[i].tolist()) for i in at]


def test_long_text_is_handled_in_passes(monkeypatch):
    text = LONG.encode()
    whole = [np.concatenate(x) for x in zip(*S.units(text, 80), strict=True)]
    monkeypatch.setattr(S, "WINDOWS_PER_PASS", 128)
    S._powers.cache_clear()
    parts = [np.concatenate(x) for x in zip(*S.units(text, 80), strict=True)]
    S._powers.cache_clear()
    assert whole[4].sum() == parts[4].sum() == len(text) - S.WINDOW + 1
