import random

import numpy as np
import pytest
import xxhash

from pitchgrid.llm import simhash as S
from pitchgrid.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, rep int, component_id int"


def print_of(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """{doc_id: (fingerprint, smallest linked id)}; rows with one id share a node."""
    prints = [(d, print_of(t)) for d, t in rows]
    parent = {d: d for d, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, p in prints:
        for e, q in prints:
            if (p ^ q).bit_count() <= 3 and root(d) != root(e):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return sorted((d, format(p, "016x"), root(d)) for d, p in prints)


def near_copies(n):
    rng = random.Random(7)
    words = [rng.choice(["alpha", "beta", "Gamma", "delta"]) + str(rng.randrange(500)) for _ in range(400)]
    out = []
    for _ in range(n):
        w = list(words)
        w[rng.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    return out


def test_equals_brute_force(spark):
    texts = [None, "", "  \t", "one", "two words", "ONE", "É x y z", *near_copies(30), "a b c d e", "a b c d f"]
    rows = list(enumerate(texts)) + [(3, "another text for id three"), (4, "two words")]
    out = S.near_duplicates(spark.createDataFrame([(d, t, "f", 1, 2) for d, t in rows], SCHEMA))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(r) for r in out.collect()) == brute(rows)


def test_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted(tuple(r) for r in S.near_duplicates(docs).collect()) == brute([tuple(r) for r in docs.collect()])


def test_links_find_every_pair_up_to_three_bits(spark):
    rng, base = np.random.default_rng(1), 0x0123456789ABCDEF
    prints = {base}
    for n in range(1, 6):
        for _ in range(60):
            flip = sum(1 << int(b) for b in rng.choice(64, n, replace=False))
            prints.add(base ^ flip)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    got = {tuple(r) for r in S.links(spark.createDataFrame(rows, "rep long, fp long")).collect()}
    want = {(a, b) for a, p in rows for b, q in rows if a > b and ((p ^ q) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_probes_of_a_small_table_are_not_broadcast(spark, tmp_path):
    spark.range(200).selectExpr("id as rep", "xxhash64(id) as fp").write.parquet(str(tmp_path / "nodes"))
    plan = S.links(spark.read.parquet(str(tmp_path / "nodes")))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_null_ids_repeats_and_empty_table(spark):
    rows = [(None, "a b c", "", 1, 1), (2, "a b c", "", 1, 1), (2, "a b c", "", 1, 1), (9, "a b c", "", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in S.near_duplicates(docs).collect()) == [("2", "2"), ("2", "2"), ("9", "2"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in S.drop_near_duplicates(docs).collect()) == ["2", "None"]
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 5)], [(1, 2), (2, 1), (3, 4), (4, 5), (5, 3)]])
def test_components(spark, edges):
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    parent = {}
    for u, v in edges:
        if u != v:
            parent.setdefault(u, u)
            parent.setdefault(v, v)
    for _ in parent:
        for u, v in edges:
            if u != v:
                parent[u] = parent[v] = min(parent[u], parent[v])
    assert got == parent
