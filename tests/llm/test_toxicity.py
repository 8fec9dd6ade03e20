import zlib

import numpy as np

from pitchgrid.llm import toxicity as T

TABLES = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    model = T.train(docs, labels)
    rows = T.score_toxicity(docs, model).join(labels, "doc_id").select("doc_id", "score", "predicted", "toxic", "lang", T.held_out(docs["doc_id"]).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.h]
    found = [r for r in held if r.predicted == 1]
    assert sum(r.toxic for r in found) / len(found) > 0.95
    for lang, least in (("en", 0.85), ("fr", 0.7), ("de", 0.7), ("es", 0.5), (None, 0.8)):
        marked = [r for r in held if r.toxic == 1 and lang in (None, r.lang)]
        print(lang, sum(r.predicted for r in marked), len(marked))
        assert sum(r.predicted for r in marked) >= least * len(marked)
    rank = np.argsort(np.argsort([r.score for r in held])) + 1
    toxic = np.array([r.toxic == 1 for r in held])
    assert (rank[toxic].mean() - (toxic.sum() + 1) / 2) / (~toxic).sum() > 0.85
    assert model.score("you are a worthless idiot and a moron, pathetic") >= T.THRESHOLD


def test_no_labels_nulls_repeats_and_empty_table(spark):
    schema = "doc_id long, text string, score string, other int"
    docs = spark.createDataFrame([(1, None, "s", 1), (1, None, "s", 1), (None, "", "s", 1), (2, "word", "s", 1)], schema)
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    model = T.train(docs, none)
    out = T.score_toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "other", "score", "predicted"]
    assert len({r.score for r in out.collect()}) == 1
    assert T.score_toxicity(spark.createDataFrame([], schema), model).count() == 0
    one_class = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert T.train(docs, one_class).score("x") > 0.9


def test_features_ignore_order_case_and_repeats():
    assert (T.features("Some WORDS here") == T.features("here some words some")).all()
    assert len(T.features(None)) == len(T.features(" \n")) == 0


def test_features_equal_brute_force():
    def ids(text):
        out = set()
        for word in {f" {w} " for w in (text or "").lower().split()}:
            for n in {*T.ORDERS, *T.INITIAL}:
                for i in range(len(word) - n + 1 if n in T.ORDERS else min(1, max(0, len(word) - n + 1))):
                    key = ord(word[i])
                    for c in word[i + 1 : i + n]:
                        key = (key * int(T.MULTIPLIER) + ord(c)) % 2**64
                        key ^= key >> 29
                    out.add((key * int(T.MIXER) % 2**64) >> (64 - T.BUCKET_BITS))
        return sorted(out)

    for text in [None, "", "a", "ab", "réeuxment ré", "Some words, of 12 lengths: abcdefghijklmnop 日本語テキスト日本語 x"]:
        assert T.features(text).tolist() == ids(text)


def test_ratios_and_fit_equal_their_definitions():
    rng = np.random.default_rng(3)
    label = (rng.random(300) < 0.3).astype(int)
    rows = [np.flatnonzero(rng.random(40) < np.where(np.arange(40) < 6, 0.1 + 0.7 * y, 0.3)) for y in label]
    counts = np.zeros((2, T.BUCKETS))
    for y, x in zip(label, rows, strict=True):
        counts[y, x] += 1
    ratio = T.ratios(counts, np.array([(label == 0).sum(), label.sum()]))
    p, q = counts[1] + 1, counts[0] + 1
    for f in range(40):
        both, share = counts[:, f].sum(), [1 - label.mean(), label.mean()]
        evidence = 2 * sum(counts[y, f] * np.log(counts[y, f] / (both * share[y])) for y in (0, 1) if counts[y, f])
        want = np.log(p[f] / p.sum()) - np.log(q[f] / q.sum()) if both >= T.MIN_TEXTS and evidence >= T.MIN_EVIDENCE else 0
        assert abs(ratio[f] - want) < 1e-9
    assert (ratio[:6] > 0).all() and not ratio[40:].any()
    model = T.fit(rows, label, ratio, label.mean())
    x = np.zeros((300, 40))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r]
    w = np.divide(model.weights[:40], ratio[:40], out=np.zeros(40), where=ratio[:40] != 0)
    residual = 1 / (1 + np.exp(-(x @ w + model.bias))) - label
    assert abs(residual.sum()) < 1 and np.abs((x.T @ residual + T.L2 * w)[ratio[:40] != 0]).max() < 1


def test_repeated_ids_are_learnt_once_and_extra_columns_stay_out(spark):
    texts = [(i, f"{'awful' if i % 2 else 'kind'} text number {i}", "k") for i in range(80)]
    docs = spark.createDataFrame(texts + [(1, "zzz other text", "k")] * 3, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] * 2, "doc_id long, toxic int, quality int")
    models = [T.train(d, labels) for d in (docs, docs.orderBy("text"))]
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias
    assert models[0].score("an awful thing " * 30_000) > 0.7 > models[0].score("kind thing")
