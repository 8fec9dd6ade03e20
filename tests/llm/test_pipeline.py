import numpy as np
import pytest

import corpus_pipeline as P
from pitchgrid.llm import piece_codec
from pitchgrid.llm.registry import piece_model
from tests.llm import test_decontamination, test_line_runs, test_near_copies, test_suffix_repetition

DIR = "/root/testdata/sf0.001"


def brute(docs, items):
    """{doc_id: ids} of the pipeline, stage by stage in plain Python."""
    kept = []
    for d, text in docs:
        n, _, _, _, repeats, covered, longest = test_suffix_repetition.brute(text)
        if n >= 50 and 100 * repeats <= 50 * n and covered <= 0.3 * n and longest <= 200:
            kept.append((d, text))
    kept = [(d, t) for d, (t, gone) in test_line_runs.brute(kept).items() if not gone or t.strip(" \t\n\x0b\x0c\r")]
    first = test_near_copies.brute(kept)
    kept = [(d, t) for d, t in kept if first[d] == d]
    leaks = {d for d, *_ in test_decontamination.brute(kept, items)}
    codec = piece_codec.codec(piece_model())
    return {d: np.frombuffer(codec.encode(t), np.int32).tolist() for d, t in kept if d not in leaks}


def test_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    rows = P.run(spark, DIR).collect()
    assert all(r.round_trip for r in rows)
    want = brute(docs, items)
    assert {r.doc_id: r.ids for r in rows} == want and len(rows) == len(want) < len(docs)


@pytest.mark.parametrize("name,stage", P.STAGES[:-1])
def test_stages_keep_the_columns_and_clean_documents(spark, name, stage):
    clean = " ".join(f"clean{i}" for i in range(120))
    rows = [(1, clean, "en", "s", len(clean)), (2, None, None, None, None), (None, clean + " x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, DIR)
    assert out.schema.names == docs.schema.names and 1 in [r.doc_id for r in out.collect()]
    assert stage(spark, docs.limit(0), DIR).count() == 0
