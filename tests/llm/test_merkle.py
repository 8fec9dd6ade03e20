import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pitchgrid.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def climb(levels, i, digest, fanout):
    """(digest at the top, siblings) from place i of the lowest level."""
    used = []
    for level in levels[:-1]:
        s = i // fanout * fanout
        run = level[s : s + fanout]
        used += run[: i - s] + run[i - s + 1 :]
        digest, i = h(*run[: i - s], digest, *run[i - s + 1 :]), i // fanout
    return digest, used


def brute(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one list per row."""
    langs = sorted({r[2] for r in rows}, key=lambda x: b"" if x is None else b"=" + x.encode())
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for x in langs]
    trees = [levels_of([leaf_of(r) for r in g], fanout) for g in groups]
    upper = levels_of([t[-1][0] for t in trees], fanout)
    out = []
    for k, (g, tree) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(g):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            top, a = climb(tree, i, leaf_of(r, int(hit)), fanout)
            top, b = climb(upper, k, top, fanout)
            out.append((r[0], leaf_of(r), tree[-1][0], upper[-1][0], h(*a, *b), top, top == upper[-1][0]))
    return sorted(out, key=repr)


def digests(spark, rows):
    return sorted((tuple(r) for r in M.tampering_digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def table():
    langs = ["en"] * 23 + ["de"] * 4 + ["é"] * 3 + ["z"] * 2 + ["one", "", None, None, None]
    rows = [(900 - 7 * i, f"text é {i}\x00", x, "s" if i % 3 else None, i if i % 5 else None) for i, x in enumerate(langs)]
    rows += [(None, None, None, None, None), (None, "", "en", "", 0), (5, "same", "en", "s", 4), (5, "same", "en", "s", 4), (5, "other", "en", "s", 2**63 - 1)]
    return rows + [(10**6, "word " * 300_000, "fr", "long", 1)]


def test_query_equals_brute_force(spark):
    rows = table()
    got = digests(spark, rows)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("fanout,levels", [(2, 1), (2, 3), (3, 2), (5, 1)])
def test_superblocks_of_any_size_give_the_same_tree(spark, fanout, levels):
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA)
    m = M.manifest(docs, M.leaf_digest([F.col(c) for c in M.COLUMNS]), fanout=fanout, levels=levels)
    m = m.withColumn("folded", M.folded_root(F.col("leaf"), fanout)).collect()
    got = sorted((r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), h(bytes(r.proof).hex())) for r in m if r.doc_id is not None)
    assert got == sorted(x[:5] for x in brute(rows, fanout) if x[0] is not None) and len(m) == len(rows)
    assert all(r.folded == r.root for r in m)


def test_every_size_of_a_group(spark):
    for n in (1, 2, 3, 7, 8, 9):
        rows = [(i, "t", "en", "s", 1) for i in range(n)]
        got = M.manifest(spark.createDataFrame(rows, SCHEMA), M.leaf_digest([F.col(c) for c in M.COLUMNS]), levels=1).collect()
        assert {r.root.hex() for r in got} == {levels_of([leaf_of(r) for r in rows], 2)[-1][0]}


def test_empty_table_and_clashing_columns(spark):
    assert digests(spark, []) == []
    rows = [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as i", "2 as n", "'x' as key", "'y' as leaf", "0 as root")
    assert sorted((tuple(r) for r in M.tampering_digests(docs).collect()), key=repr) == brute(rows)


def test_no_window_or_group_by_language_alone(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA)
    plan = M.tampering_digests(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan or "range" in plan
