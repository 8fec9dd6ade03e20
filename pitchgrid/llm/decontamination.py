"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Words are lower-cased runs of characters other than space and \\t \\n \\v \\f \\r; a shingle is five successive words (an item
of one to four words is one shingle of that length). Items are partitioned by size class, the power of two at or below
their number of distinct shingles n. From each, the m smallest shingle hashes are kept (a bottom-m MinHash sketch), m
being one more than the shingles that the largest item of the class may miss at the wanted containment. A document that
holds enough of an item therefore holds at least one sketched shingle, whatever the document's length: no link is lost.
Documents that hit a sketch are candidates; the shingles of these alone are compared as text with the whole items.

The sketches and the candidates' ids are broadcast only if counted to be within ``max_broadcast_rows``; beyond it the
same joins shuffle.

Defined cases: null or wordless texts and items match nothing; rows with one doc_id (item_id) in common count as one
document (item); rows with a null id are never reported, but ``decontaminate`` judges each row by its own text and removes
them too; very long texts are searched whole; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.storage import materialised

SHINGLE, CONTAINMENT = 5, 0.8
MAX_BROADCAST_ROWS = 1_000_000
WHITE = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _windows(words: Column, length: int, make) -> Column:
    """make(i) for the start i of each window of that many words."""
    last = F.size(words) - length
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), make)).otherwise(F.array())


def _hashes(words: Column, length: int) -> Column:
    return _windows(words, length, lambda i: F.xxhash64(F.lit(length), *[F.get(words, i + k) for k in range(length)]))


def _texts(words: Column, length: int) -> Column:
    return _windows(words, length, lambda i: F.array_join(F.slice(words, i + 1, length), " "))


def _small(df: DataFrame, limit: int) -> DataFrame:
    """df marked for broadcast if it is counted to have limit rows or fewer."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _item_shingles(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, length, shingle, h) and the item's number of them, n_item."""
    words = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), _words(F.col(text_col)).alias("w"))
    cut = F.when(F.size("w") >= SHINGLE, _windows(F.col("w"), SHINGLE, lambda i: F.slice("w", i + 1, SHINGLE))).otherwise(F.array("w"))
    each = words.where("w is not null").select("item_id", F.explode(cut).alias("s"))
    length = F.size("s")
    hashed = F.xxhash64(length, *[F.get("s", F.lit(k)) for k in range(SHINGLE)])
    # a null argument leaves a hash as it is, so shorter shingles hash like _hashes does
    each = each.select("item_id", length.alias("length"), F.array_join("s", " ").alias("shingle"), hashed.alias("h")).distinct()
    return each.join(each.groupBy("item_id").agg(F.count("*").alias("n_item")), "item_id")


def _sketch(shingles: DataFrame, containment: float) -> DataFrame:
    """The smallest hashes of each item, as many as its size class needs."""
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1) - 1
    wanted = F.floor(largest * (1 - containment) + 1e-9) + 1
    smallest = F.slice(F.array_sort(F.collect_set("h")), 1, F.first(wanted).cast("int"))
    return shingles.groupBy("item_id").agg(smallest.alias("hs")).select(F.explode("hs").alias("h")).distinct()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    containment: float = CONTAINMENT,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every pair whose containment of the item is high enough."""
    items = materialised(_item_shingles(benchmark, item_col, text_col))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # 1 to 5
    sketch = _small(materialised(_sketch(items, containment)), max_broadcast_rows)
    words = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("w")).where("w is not null")
    hashes = F.concat(*[_hashes(F.col("w"), n) for n in lengths]) if lengths else F.array().cast("array<bigint>")
    hits = words.select("doc_id", F.explode(hashes).alias("h")).join(sketch, "h", "left_semi")
    candidates = _small(materialised(hits.select("doc_id").distinct()), max_broadcast_rows)
    texts = F.concat(*[_texts(F.col("w"), n) for n in lengths]) if lengths else F.array().cast("array<string>")
    found = words.join(candidates, "doc_id", "left_semi").select("doc_id", F.explode(texts).alias("shingle"))
    whole = _small(items.select("item_id", "shingle", "n_item"), max_broadcast_rows)
    shared = found.join(whole, "shingle").select("doc_id", "item_id", "n_item", "shingle").distinct()
    return (
        shared.groupBy("doc_id", "item_id", "n_item")
        .agg(F.count("*").alias("n_shared"))
        .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
        .where(F.col("n_shared") >= F.col("n_item") * containment - 1e-9)
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", max_broadcast_rows: int = MAX_BROADCAST_ROWS, **options
) -> DataFrame:
    """docs without the documents that hold a benchmark item, judged row by row: ids, null or repeated ones too, don't matter."""
    text_col = options.get("text_col", "text")
    # equal texts are judged alike, so the text's digest is the id
    keyed = docs.withColumn("__pg_key", F.unhex(F.md5(F.col(text_col).cast("string"))))
    pairs = contaminated(keyed, benchmark, id_col="__pg_key", max_broadcast_rows=max_broadcast_rows, **options)
    leaks = _small(materialised(pairs.select(F.col("doc_id").alias("__pg_leak")).distinct()), max_broadcast_rows)
    return keyed.join(leaks, F.col("__pg_key") == F.col("__pg_leak"), "left_anti").drop("__pg_key")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
bs AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
      ELSE [array_to_string(w, ' ')] END) AS s
  FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d WHERE len(w) >= 5)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item)::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9
"""
