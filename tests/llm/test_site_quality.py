import math

import pytest
from pyspark.sql import functions as F

from pitchgrid.llm import site_quality as Q

SCHEMA = "doc_id long, text string, source string, lang string, kept string"


def run(spark, rows, labels=(), **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    return Q.site_quality(docs, spark.createDataFrame(list(labels), "doc_id long, quality int"), F.col("source"), F.col("lang"), **options)


def test_out_of_fold_accuracy_of_the_evidence_and_the_score(spark):
    """Each row is scored by a model that hasn't seen its label, so all labelled rows are held out."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = Q.site_quality(docs, labels, F.col("source"), F.col("lang")).join(labels, "doc_id")
    right = lambda c: F.avg((c == (F.col("quality") == 1)).cast("int"))
    good = F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int")))
    r = held.agg(right(F.col("kept")).alias("a"), right(F.col("doc_score") >= 0.5).alias("d"), good.alias("g"), F.count("*").alias("n")).first()
    assert r.n > 3000 and r.a > 0.98 and r.d > 0.98 and r.g > 0.98


def brute_force(p, sites):
    """Global mean, strengths and leave-one-out posteriors by plain loops over rows."""
    groups = lambda keys: {k: [x for x, j in zip(p, keys) if j == k] for k in set(keys)}
    mean = (sum(p) + 0.5) / (len(p) + 1)
    hosts, paths = groups([h for h, _ in sites]), groups(sites)

    def strength(parts, above):
        n = sum(map(len, parts.values()))
        own = {k: sum(v) / len(v) for k, v in parts.items()}
        within = sum((x - own[k]) ** 2 for k, v in parts.items() for x in v) / n
        between = sum(len(v) * (own[k] - above(k)) ** 2 for k, v in parts.items())
        spread = max(between - len(parts) * within, 0) / n
        return min(max(within / spread, Q.MIN_STRENGTH), Q.MAX_STRENGTH) if spread > 0 and len(parts) > 1 else Q.MAX_STRENGTH

    k_host = strength(hosts, lambda h: mean)
    k_path = strength(paths, lambda s: sum(hosts[s[0]]) / len(hosts[s[0]]))
    out = []
    for x, (h, q) in zip(p, sites):
        of_host = (sum(hosts[h]) - x + k_host * mean) / (len(hosts[h]) - 1 + k_host)
        out.append((of_host, (sum(paths[h, q]) - x + k_path * of_host) / (len(paths[h, q]) - 1 + k_path)))
    return out


def test_posteriors_of_sparse_sites_equal_brute_force(spark):
    import random

    rng, rows, labels = random.Random(5), [], []
    words = [["clear", "plain", "useful", "reading"], ["##junk", "SPAM", "$$9", "free"]]
    for i in range(300):
        host = f"host{min(int(rng.expovariate(0.3)), 40)}"  # some hosts with most rows, many with one or two
        bad = rng.random() < (0.8 if hash_of(host) else 0.15)
        text = " ".join(rng.choice(words[bad if rng.random() < 0.7 else 1 - bad]) for _ in range(rng.randrange(1, 30)))
        rows.append((i, text, host, rng.choice(["a", "b", None]), "k"))
        if i % 2:
            labels.append((i, int(not bad)))
    got = run(spark, rows, labels).collect()
    assert any(sum(r.source == h for r in got) < 3 for h in {r.source for r in got})
    want = brute_force([r.doc_score for r in got], [(r.source, r.lang) for r in got])
    assert len(got) == 300 and len({r.doc_score for r in got}) > 100
    for r, (h, q) in zip(got, want, strict=True):
        assert abs(r.host_posterior - h) < 1e-9 and abs(r.path_posterior - q) < 1e-9


def hash_of(host):
    return int(host[4:]) % 2


def test_own_label_does_not_reach_own_evidence(spark):
    rows = [(i, ("good words here " if i % 2 else "bad junk there ") * (1 + i % 5) + "1" * (i % 3 + 2 * (i % 2)), "s", "l", "k") for i in range(60)]
    labels = [(i, i % 2) for i in range(60)]
    score = lambda ls: {r.doc_id: r.doc_score for r in run(spark, rows, ls).collect()}
    was, now = score(labels), score([(0, 1), *labels[1:]])
    assert was[0] == now[0] and any(was[i] != now[i] for i in was)


def test_very_long_text_and_clashing_columns(spark):
    docs = [(1, "word " * 300_000, "s", "l", "k"), (2, "x", "s", "l", "k")]
    out = run(spark, docs, [(1, 1), (2, 0)]).collect()
    assert sorted(r.doc_id for r in out) == [1, 2] and all(0 < r.score < 1 for r in out)
    clash = spark.createDataFrame(docs, SCHEMA).withColumns({"p": F.lit(1), "symbols": F.lit("z"), "n": F.lit(3), "score": F.lit("old")})
    got = Q.site_quality(clash, spark.createDataFrame([], "doc_id long, quality int"), F.col("source"), F.col("lang"))
    assert got.columns == ["doc_id", "source", "lang", "p", "symbols", "n", *Q.RESULTS] and {r.symbols for r in got.collect()} == {"z"}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_posteriors_follow_the_formulas(spark, limit):
    good = [(i, "a plain text with quite a few words in it number " + "x" * (i % 7), "big" if i % 2 else None, "en", "k") for i in range(40)]
    bad = [(100 + i, "### $$$ 12345 ### " * 5, "bad", "en" if i else "fr", "k") for i in range(20)]
    labels = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(15)]
    rows = run(spark, good + bad, labels, max_broadcast_rows=limit).collect()
    assert len(rows) == 60 and all(r.kept == (r.doc_id < 100) for r in rows)
    mean = (sum(r.doc_score for r in rows) + 0.5) / 61
    logit = lambda p: math.log(p / (1 - p))
    clip = lambda p: min(max(p, Q.EDGE), 1 - Q.EDGE)
    for r in rows:
        z = logit(clip(r.doc_score)) + logit(clip(r.path_posterior)) - logit(mean)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9
    alone = next(r for r in rows if r.doc_id == 100)  # the only one of its path: nothing but its host speaks for it
    assert abs(alone.path_posterior - alone.host_posterior) < 1e-9
    assert alone.host_posterior < mean


def test_no_labels_nulls_repeats_and_empty_table(spark):
    rows = [(1, None, None, None, "k"), (1, None, None, None, "k"), (None, "", "s", "l", "k")]
    out = run(spark, rows)
    assert out.columns == ["doc_id", "source", "lang", *Q.RESULTS]
    assert {r.doc_score for r in out.collect()} == {0.5}
    assert run(spark, []).count() == 0
