import random

import pytest

import corpus_pipeline
from pitchgrid.llm import near_copies as N
from pitchgrid.llm import simhash

SCHEMA = "doc_id long, text string"


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """{doc_id: smallest doc_id linked}, by comparing all pairs of shingle sets; every row has its own id."""
    parent, sets = {d: d for d, _ in rows}, [(d, sets_of(t)) for d, t in rows]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if 5 * len(a & b) >= 4 * len(a | b) and root(d) != root(e):
                low, high = sorted((root(d), root(e)))
                parent[high] = low
    return {d: root(d) for d in parent}


def edited(n):
    """Texts of 30 to 200 words, each with copies of 0 to 6 changed words, chains of copies and a common passage."""
    rng, common = random.Random(5), [f"common{i}" for i in range(30)]
    out = []
    for base in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200))] + common * (base % 2)
        for _ in range(5):
            out.append(" ".join(words))
            copy = list(words)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            words = copy if rng.random() < 0.5 else words
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sample", [N.SAMPLE, 1])
def test_every_similar_pair_is_linked(spark, monkeypatch, sample):
    monkeypatch.setattr(N, "SAMPLE", sample)
    rows = list(enumerate([None, "", " \t", "one", "ONE", "a b c d", *edited(25)]))
    got = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_exact_prefixes(spark):
    assert N.prefix_length(1000, 0, None) == N.prefix_length(1000, 0, 0) == 201 > N.prefix_length(1000, 0)
    rows = list(enumerate(edited(12)))
    got = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(rows, SCHEMA), miss=None).collect()}
    assert got == brute(rows)


def test_driver_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_stage_drops_copies_beyond_three_bits(spark):
    words = [f"word{i}" for i in range(120)]
    copies = [" ".join("edit" if i in (a, a + 40) else w for i, w in enumerate(words)) for a in (10, 20, 30)]
    rows = [r for r in [(1, " ".join(words)), *enumerate(copies, 2)] if r[0] == 1 or (simhash.fingerprint(r[1]) ^ simhash.fingerprint(" ".join(words))).bit_count() > 3]
    assert len(rows) > 1
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()] == [1]


def test_null_ids_shared_ids_and_empty_table(spark):
    rows = [(None, "a b c"), (2, "a b c"), (2, "a b c"), (9, "a b c"), (9, "other words"), (11, "other words")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((str(r.doc_id), r.component_id) for r in N.near_copies(docs).collect() if r.doc_id) == [("11", 2), ("2", 2), ("2", 2), ("9", 2), ("9", 2)]
    assert sorted(str(r.doc_id) for r in N.drop_near_copies(docs).collect()) == ["2", "None"]
    assert N.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_simhash_finds_candidates_and_sets_confirm_them(spark, monkeypatch):
    """Texts with few shingles in common but one fingerprint stay apart; copies within 3 bits are joined before prefixes are compared."""
    rows = list(enumerate(edited(8)))
    seen, inner = [], N._similar
    monkeypatch.setattr(N, "_similar", lambda pairs, docs: seen.append({(r.u, r.v) for r in pairs.collect()}) or inner(pairs, docs))
    got = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    prints = dict((d, simhash.fingerprint(t)) for d, t in rows)
    near = {(d, e) for d, a in prints.items() for e, b in prints.items() if e < d and (a ^ b).bit_count() <= 3}
    assert len(seen) == 3 and seen[0] and seen[0] <= near and not seen[0] & seen[1]
    apart = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, -1)], "rep long, sim long")
    assert {tuple(r) for r in N.simhash_candidates(apart).collect()} == {(2, 1), (3, 1)}


def test_nothing_of_the_size_of_prefixes_or_pairs_is_broadcast(spark, monkeypatch):
    plans, inner = [], N.materialised
    monkeypatch.setattr(N, "FEW", 0)
    monkeypatch.setattr(N, "materialised", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or inner(df))
    docs = spark.createDataFrame(list(enumerate(edited(4))), SCHEMA)
    plans.append(N.near_copies(docs)._jdf.queryExecution().sparkPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 9
    assert not [p for p in plans if "Broadcast" in p]
