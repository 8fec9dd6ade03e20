"""Quality rules by suffix-array repetition.

Each text is a sequence of words (maximal runs of bytes other than space and \\t \\n \\v \\f \\r). The
suffixes of its word sequence are sorted by prefix doubling, many texts at a time in numpy. Between suffix-array
neighbours the longest common prefix is found from the doubling ranks; the LCP intervals of at least ``min_repeat`` words
are the maximal repeated substrings. A text is rejected when the union of their spans covers more than
``max_covered`` of its words or the longest of them exceeds ``max_longest`` words.

Defined cases: a null text counts as empty; an empty text has zero counts, no repeats and fails the base rule on its word
count; repeated rows give repeated, equal results; null ids pass through; columns of the input that share a name with a
result column are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.storage import in_small_batches

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.3, 200
#: Words sorted together; bounds the memory of one numpy pass unless a single text is longer.
WORDS_PER_PASS = 100_000

FIELDS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("n_covered", pa.int64()),
    ("longest_repeat", pa.int64()),
]
SCHEMA = "struct<" + ",".join(f"{name}:bigint" for name, _ in FIELDS) + ">"


def _suffix_order(words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of all texts, text by text, and the ranks at each doubling level.

    words: word ids; doc: text of each position; end: end position of that text. A rank is the place of the first
    suffix of its group, so groups of equal prefixes keep their place while they are refined.
    """
    n = len(words)
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    start = np.ones(n, bool)
    start[1:] = key[order[1:]] != key[order[:-1]]
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = first
    levels, width = [rank.copy()], 1
    while True:
        tied = np.bincount(rank, minlength=n)
        active = order[tied[rank[order]] > 1]
        if not len(active):
            return order, levels
        ahead = active + width
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        old = rank[active]
        by = np.lexsort((second, old))
        active, second, old = active[by], second[by], old[by]
        place = np.arange(len(active))
        fresh = np.ones(len(active), bool)
        fresh[1:] = old[1:] != old[:-1]
        group = np.maximum.accumulate(np.where(fresh, place, 0))
        fresh[1:] |= second[1:] != second[:-1]
        sub = np.maximum.accumulate(np.where(fresh, place, 0))
        order[old + place - group] = active
        rank = rank.copy()
        rank[active] = old + sub - group
        levels.append(rank)
        width *= 2


def _neighbour_lcp(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Longest common prefix, in words, of each suffix and the next one in order; 0 across texts."""
    n = len(order)
    out = np.zeros(n, np.int64)
    left, right = order[:-1], order[1:]
    open_ = np.flatnonzero(levels[0][left] == levels[0][right])
    x, y, got = left[open_].copy(), right[open_].copy(), np.zeros(len(open_), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((x < end[left[open_]]) & (y < end[right[open_]]))
        same = inside[levels[k][x[inside]] == levels[k][y[inside]]]
        step = 1 << k
        x[same] += step
        y[same] += step
        got[same] += step
    out[open_] = got
    return out


def _union_sizes(at: np.ndarray, length: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Positions covered by the spans [at, at + length), counted per text."""
    steps = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + length, minlength=n + 1)[: n + 1]
    covered = np.concatenate(([0], np.cumsum(np.cumsum(steps[:n]) > 0)))
    return covered[offsets[1:]] - covered[offsets[:-1]]


def _repeats(ids: np.ndarray, offsets: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words in repeated 3-word windows, words in repeats of min_repeat or more, longest repeat."""
    sizes = np.diff(offsets)
    n, longest = int(offsets[-1]), np.zeros(len(sizes), np.int64)
    if not n:
        return longest, longest.copy(), longest.copy()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(offsets[1:], sizes)
    order, levels = _suffix_order(ids, doc, end)
    lcp = _neighbour_lcp(order, levels, end)
    here = lcp.copy()
    here[1:] = np.maximum(lcp[1:], lcp[:-1])
    length = np.empty(n, np.int64)
    length[order] = here
    np.maximum.at(longest, doc[order[lcp > 0]], lcp[lcp > 0])
    three, long = np.flatnonzero(length >= 3), np.flatnonzero(length >= min_repeat)
    return _union_sizes(three, np.full(len(three), 3), offsets, n), _union_sizes(long, length[long], offsets, n), longest


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> pa.StructArray:
    """All measures of each text; see FIELDS."""
    rows: dict[str, list] = {name: [] for name, _ in FIELDS}
    held: list[list[bytes]] = []

    def flush() -> None:
        number = defaultdict(count().__next__)
        ids = np.fromiter((number[w] for words in held for w in words), np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(words) for words in held]))).astype(np.int64)
        for name, values in zip(("n_repeat_words", "n_covered", "longest_repeat"), _repeats(ids, offsets, min_repeat), strict=True):
            rows[name].extend(values.tolist())
        held.clear()

    waiting = 0
    for text in texts:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # for bytes: exactly the six ASCII white-space characters
        lines = [x for x in raw.split(b"\n") if x.strip()]
        rows["n_words"].append(len(words))
        rows["word_chars"].append(len(text) - (len(raw) - len(raw.translate(None, WHITE))))
        rows["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
        rows["n_dup_lines"].append(len(lines) - len(set(lines)))
        held.append(words)
        waiting += len(words)
        if waiting >= WORDS_PER_PASS:
            flush()
            waiting = 0
    flush()
    return pa.StructArray.from_arrays([pa.array(rows[name], kind) for name, kind in FIELDS], [name for name, _ in FIELDS])


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """docs with the measures, ``covered_fraction``, ``base_failed`` and ``kept`` appended. No shuffle."""

    @F.arrow_udf(SCHEMA)
    def measured(text: pa.Array) -> pa.Array:
        return measure(text.to_pylist(), min_repeat)

    names = [name for name, _ in FIELDS] + ["covered_fraction", "base_failed", "kept", "__pg_m"]
    kept_columns = [c for c in docs.columns if c not in names]
    m = in_small_batches(docs).select(*kept_columns, measured(F.col(text_col).cast("string")).alias("__pg_m")).select(*kept_columns, "__pg_m.*")
    return (
        m.withColumn("covered_fraction", F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(F.lit(0.0)))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
        .withColumn("kept", ~F.col("base_failed") & (F.col("covered_fraction") <= max_covered) & (F.col("longest_repeat") <= max_longest))
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
i AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, (VALUES (3), (10), (201)) AS t(k) WHERE len(w) >= k),
r AS (
  SELECT doc_id, k, i FROM i QUALIFY count(*) OVER (PARTITION BY doc_id, k, md5(array_to_string(w[i:i+k-1], ' '))) > 1),
c AS (SELECT doc_id, k, count(DISTINCT i + j) AS n FROM r, range(0, 201) AS o(j) WHERE j < k GROUP BY doc_id, k),
p AS (SELECT doc_id, max(n) FILTER (k = 3) AS n3, max(n) FILTER (k = 10) AS n10, max(n) FILTER (k = 201) AS n201 FROM c GROUP BY doc_id),
m AS (
  SELECT n.doc_id, n_words, word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n3, 0) AS n_repeat_words, coalesce(n10, 0) AS n_covered,
    CASE WHEN n_words > 0 THEN coalesce(n10, 0) / n_words::DOUBLE ELSE 0E0 END AS covered_fraction, n201 FROM n LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, covered_fraction, base_failed,
  NOT base_failed AND covered_fraction <= 0.3E0 AND n201 IS NULL AS kept FROM f
"""
