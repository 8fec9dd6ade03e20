import random

import numpy as np
import pytest
import sentencepiece

from pitchgrid.llm import piece_codec as K
from pitchgrid.llm.registry import piece_model

RNG = random.Random(2)
TEXTS = [
    "", " ", "  two  spaces ", "tab\tand\nlines\r\n", "日本語テキスト", "".join(RNG.choice("aeiouxyz ") for _ in range(700)), "0123456789abcdef" * 60,
    "a" * 500, " " * 300, "internationalisation-and-other-very-long-words" * 15, "naïve café № 😀 x",
]


@pytest.fixture(scope="module")
def codec():
    return K.codec(piece_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_ids_are_the_librarys_and_decode_to_the_text(codec, library):
    for text in TEXTS:
        ids = np.frombuffer(codec.encode(text), np.int32)
        assert ids.tolist() == library.encode(text)
        assert codec.decode(ids) == text
    literal = "a▁b ▁▁"
    assert codec.decode(np.frombuffer(codec.encode(literal), np.int32)) == literal


def by_chunks(c, text, size):
    out = []
    for part, s in enumerate(c.marked(text)):
        cuts = [x for x in range(0, max(len(s), 1), size) if x == 0 or len(s) - x >= c.reach]
        ends = [*cuts[1:], len(s)]
        rows = [(s[max(0, a - c.reach) : b + c.reach - 1], a - max(0, a - c.reach), b - max(0, a - c.reach)) for a, b in zip(cuts, ends, strict=True)]
        matrices = [c.matrix(*r) for r in rows]
        if len(matrices) > 2:
            one, two, three = matrices[:3]
            assert K.combine(K.combine(one, two), three) == K.combine(one, K.combine(two, three)) != {}
        out += [c.literal] * bool(part) + [c.chunk_ids(*r, *x) for r, x in zip(rows, K.states(matrices), strict=True)]
    return b"".join(out)


@pytest.mark.parametrize("size", [17, 40, 101])
def test_chunks_give_the_whole_texts_ids(codec, size):
    for text in [*TEXTS, "a▁b  ▁" * 40]:
        assert by_chunks(codec, text, size) == codec.encode(text)


def test_query_paths_nulls_repeats_clashing_names_and_empty_table(spark, codec):
    schema = "doc_id long, text string, ids string, k int, part int"
    texts = [None, *TEXTS, "x▁" * 90, TEXTS[5]]
    rows = [(i, t, "q", 1, 1) for i, t in enumerate(texts)] + [(None, TEXTS[5], "q", 1, 1)] * 2
    out = K.decode(K.encode(spark.createDataFrame(rows, schema), piece_model(), chunk=64), piece_model())
    assert out.columns == ["doc_id", "k", "part", "text_key", "ids", "n_tokens", "text"]
    got = [(str(r.doc_id), r.text, r.ids) for r in out.collect()]
    key = lambda x: (x[0], str(x[1]))
    want = [(str(r[0]), r[1], None if r[1] is None else np.frombuffer(codec.encode(r[1]), np.int32).tolist()) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    checked = K.encode(spark.createDataFrame(rows, schema), piece_model(), chunk=64, verify=True).collect()
    assert len(checked) == len(rows) and {r.round_trip for r in checked} == {True, None}
    assert K.encode(spark.createDataFrame([], schema), piece_model()).count() == 0


def test_driver_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in K.encode_and_check(docs, piece_model()).collect():
        assert r.round_trip and r.n_tokens == len(r.ids) and r.ids == library.encode(texts[r.doc_id])


def test_scan_states_are_the_folds(spark):
    """Any number of matrices, ties and weights: the states of grouped rounds weigh as much as those of one fold."""
    rng = random.Random(4)
    texts = {(n, 5, part): [{(rng.randrange(3) if k else 0, rng.randrange(3) if k < n - 1 else 0): float(rng.randrange(-4, 0)) for _ in range(9)} for k in range(n)]
             for n in (1, 2, 3, 7, 20) for part in (0, 1)}
    for matrices in texts.values():
        for m in matrices:
            m.setdefault((0, 0), -9.0)
    rows = [(*place, k, K._stored(m)) for place, matrices in texts.items() for k, m in enumerate(matrices)] + [(None, 5, 0, 0, K._stored({(0, 0): 0.0}))]
    table = spark.createDataFrame(rows, "id int, key int, part int, k int, m array<struct<entry:int,leave:int,weight:double>>")
    for fan in (2, 3):
        got = {}
        for r in K.scan(table, fan).collect():
            got.setdefault((r.id, r.key, r.part), {})[r.k] = (r.entry, r.leave)
        assert got.pop((None, 5, 0)) == {0: (0, 0)} and got.keys() == texts.keys()
        for place, matrices in texts.items():
            path = [got[place][k] for k in range(len(matrices))]
            assert all(a[1] == b[0] for a, b in zip(path, path[1:], strict=False)) and path[0][0] == path[-1][1] == 0
            weight = lambda p: sum(m[x] for m, x in zip(matrices, p, strict=True))  # noqa: B023, E731
            assert weight(path) == weight(K.states(matrices))


def test_no_task_takes_a_whole_texts_matrices(spark, capsys):
    docs = spark.createDataFrame([(1, "word " * 100)], "doc_id long, text string")
    K.encode(docs, piece_model(), chunk=64).explain()
    assert "InPandas" not in capsys.readouterr().out


@pytest.mark.parametrize("size", [5, 9])
def test_unigram_chunks_give_the_best_path(size):
    rng = random.Random(8)
    scores = {"a": -1.5, "b": -2.0, "ab": -2.5, "ba": -3.0, "aba": -3.75, "bb": -3.5, "abab": -4.25, "c": -1.0}
    model = K.Unigram(scores, -10.0)

    def best(text):
        found = [0.0] + [float("-inf")] * len(text)
        for j in range(1, len(text) + 1):
            found[j] = max(found[i] + scores.get(text[i:j], -10.0 if j - i == 1 else float("-inf")) for i in range(max(0, j - 4), j))
        return found[-1]

    for _ in range(60):
        s = "".join(rng.choice("aabbcd") for _ in range(rng.randrange(1, 60)))
        cuts = [x for x in range(0, len(s), size) if x == 0 or len(s) - x >= model.reach]
        rows = [(s[max(0, a - 4) : b + 3], a - max(0, a - 4), b - max(0, a - 4)) for a, b in zip(cuts, [*cuts[1:], len(s)], strict=True)]
        matrices = [model.matrix(*r) for r in rows]
        pieces = [p for r, x in zip(rows, K.states(matrices), strict=True) for p in model.chunk_pieces(*r, *x)]
        assert "".join(pieces) == s and sum(model._score(p) for p in pieces) == pytest.approx(best(s))
