import random
import re
from collections import Counter

from pitchgrid.llm import suffix_repetition as Q


def brute(text):
    """The measures by plain windows of every length."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    covered, longest, three = set(), 0, set()
    for size in range(1, len(words)):
        windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        often = Counter(windows)
        at = [i for i, w in enumerate(windows) if often[w] > 1]
        if not at:
            break
        longest = size
        if size == 3:
            three = {p for i in at for p in range(i, i + 3)}
        if size == Q.MIN_REPEAT:
            covered = {p for i in at for p in range(i, i + size)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(three), len(covered), longest]


RNG = random.Random(5)
TEXTS = [
    None, "", " \n\t", "w", "a b a b a b", "x " * 300, "same line\nsame line\n\nother\nsame line", "É é # $ | <b>\x0b&\x0c%",
    " ".join(RNG.choice("abc") for _ in range(200)), " ".join(str(i) for i in range(80)) + " " + " ".join(str(i) for i in range(40)),
]
SCHEMA = "doc_id long, text string, kept string, n_words int, note string"


def test_equals_brute_force_across_passes(monkeypatch):
    for limit in (1, 50, 250_000):
        monkeypatch.setattr(Q, "WORDS_PER_PASS", limit)
        assert [list(r.values()) for r in Q.measure(TEXTS).to_pylist()] == [brute(t) for t in TEXTS]


def test_driver_documents(spark):
    for r in Q.quality_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 4000")).collect():
        assert [r[name] for name, _ in Q.FIELDS] == brute(r.text)


def test_verdict_nulls_repeats_clashing_names_and_empty_table(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(None, clean, "k", 1, "n"), (1, "few words", "k", 1, "n"), (2, clean + " " + clean, "k", 1, "n"), (3, clean, "k", 1, "n"), (3, clean, "k", 1, "n"), (4, None, "k", 1, "n")]
    out = Q.quality_rules(spark.createDataFrame(rows, SCHEMA))
    assert [c for c in out.columns if c in ("doc_id", "text", "note")] == ["doc_id", "text", "note"] and len(set(out.columns)) == len(out.columns)
    got = sorted((str(r.doc_id), r.base_failed, r.kept) for r in out.collect())
    assert got == [("1", True, False), ("2", True, False), ("3", False, True), ("3", False, True), ("4", True, False), ("None", False, True)]
    assert Q.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_method_rejects_what_the_base_rules_pass(spark):
    part = " ".join(f"p{i}" for i in range(40))
    text = part + " " + " ".join(f"u{i}" for i in range(100)) + " " + part
    r = Q.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.base_failed, r.kept, r.longest_repeat, r.n_covered) == (False, False, 40, 80)
