"""Line dedup over content-defined chunks.

A rolling hash runs over the hashes of a text's lines, ``WINDOW`` lines at a time; a chunk ends after each line where it is
0 modulo ``DIVISOR``, and at the end of the text. A boundary depends on the lines just before it alone, so inserted or
deleted lines shift no other boundary. Chunks of two lines or more and ``MIN_CHARS`` characters that occur more than once in
the table keep their first occurrence (by id, then place) and lose the others.

Work goes by chunk hash, but equality is decided by grouping the repeated chunks on their bytes. Only hashes are shuffled
for the search; texts move for repeated chunks, pre-aggregated in each task, and once to put the documents together. A
chunk found in a large part of all documents is one row per task after the partial aggregation, and its occurrences are
never collected: they join a table with one row per chunk, broadcast only if counted to be small. Lines are hashed in Python
by Arrow batches; the joins and groups are Spark's.

``line_dedup`` sees a repeated passage only where a whole chunk lies in it. ``run_dedup`` sees them all: a line goes if it lies
in a run of two lines or more and ``MIN_CHARS`` characters that is equal to a run at an earlier place. It takes out the repeated chunks
first, then looks at the lines around them: every such run is a union of shortest ones, which are about one a line, so these are
searched like chunks (``shortest_runs``), but for those within a chunk that goes. Such a chunk's first occurrence holds the same runs
at an earlier place, so none of them is a first occurrence, and all of their lines go anyway. A run that
overlaps its own first occurrence stays. The text of a removed line is always left at an earlier place.

Defined cases: null texts stay null and have no lines; the lines of an empty text are one empty line; rows equal in id and
text count as one document and get equal results; rows with null ids sort last; an empty table gives an empty result;
columns that share a name with a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.llm.storage import in_small_batches, materialised

WINDOW, DIVISOR, MIN_CHARS = 2, 3, 64
PRIME, BASE = 2147483647, 31
MAX_BROADCAST_ROWS = 1_000_000
RESULTS = ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")
RUN_RESULTS = ("n_lines", "n_removed_lines")
#: Bytes of chunk text gathered before a batch goes back to Spark.
BYTES_PER_BATCH = 4_000_000


def chunk_ends(lines: list[bytes], window: int = WINDOW, divisor: int = DIVISOR) -> list[int]:
    """Index one past the last line of each chunk."""
    hashes = [int.from_bytes(md5(x, usedforsecurity=False).digest()[:4], "big") % PRIME for x in lines]
    out, value, leaving = [], 0, pow(BASE, window, PRIME)
    for i, h in enumerate(hashes):
        value = (value * BASE + h - (hashes[i - window] * leaving if i >= window else 0)) % PRIME
        if value % divisor == 0:
            out.append(i + 1)
    if not out or out[-1] != len(lines):
        out.append(len(lines))
    return out


def _chunks(text: str, window: int, divisor: int) -> list[tuple[int, list[bytes]]]:
    """(place, lines) of every chunk."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    ends = chunk_ends(lines, window, divisor)
    return [(k, lines[a:b]) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]


def shortest_runs(lines: list[bytes], min_chars: int = MIN_CHARS) -> list[tuple[int, int]]:
    """[a, b) of the shortest run of two lines or more and min_chars characters that starts, or ends, at each line, in order.

    A longer run is the union of those within it: a line too near to its end for a run to start there is covered by the run
    that ends at the line or, if too near to the start as well, by the one that starts the longer run. Equal runs hold
    equal shortest runs, whatever lies around them.
    """
    ends = [0]
    for x in lines:
        ends.append(ends[-1] + len(x.decode("utf-8", "surrogatepass")) + 1)
    out, b = set(), 2
    for a in range(len(lines) - 1):
        b = max(b, a + 2)
        while b <= len(lines) and ends[b] - ends[a] - 1 < min_chars:
            b += 1
        if b > len(lines):
            break
        out.add((a, b))
    a = 0
    for b in range(2, len(lines) + 1):
        while a + 2 < b and ends[b] - ends[a + 1] - 1 >= min_chars:
            a += 1
        if ends[b] - ends[a] - 1 >= min_chars:
            out.add((a, b))
    return sorted(out)


def _spans(lines: list[bytes], window: int, divisor: int) -> list[tuple[int, int]]:
    """[a, b) of every chunk."""
    ends = chunk_ends(lines, window, divisor)
    return list(zip([0, *ends], ends, strict=False))


def _runs(text: str, min_chars: int, window: int, divisor: int) -> Iterator[tuple[int, list[bytes], int | None]]:
    """(place, lines, place of the chunk that it lies in) of every shortest run."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    chunk = [(k, b) for k, (a, b) in enumerate(_spans(lines, window, divisor)) for _ in range(a, b)]
    return ((k, lines[a:b], chunk[a][0] if b <= chunk[a][1] else None) for k, (a, b) in enumerate(shortest_runs(lines, min_chars)))


def _chunk_rows(docs: DataFrame, chunks_of: Callable, min_chars: int, with_text: bool) -> DataFrame:
    """(id, key, at, h, within[, chunk]) of each chunk of two lines or more that is long enough; docs has __pg_id, __pg_key, __pg_text.

    chunks_of gives the (place, lines) of a text's chunks, and may give the place of what each lies within.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, hashes, inside, chunks, waiting = [], [], [], [], [], 0

            def packed(batch=batch) -> pa.RecordBatch:
                of = pa.array(row, pa.int64())
                columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(at, pa.int32()), pa.array(hashes, pa.int64()), pa.array(inside, pa.int32())]
                names = ["id", "key", "at", "h", "within"]
                if with_text:
                    columns, names = [*columns, pa.array(chunks, pa.string())], [*names, "chunk"]
                return pa.RecordBatch.from_arrays(columns, names)

            for i, text in enumerate(batch.column(2).to_pylist()):
                for k, lines, *within in chunks_of(text) if text is not None else ():
                    if len(lines) < 2:
                        continue
                    chunk = b"\n".join(lines)
                    if len(chunk) < min_chars or len(chunk.decode("utf-8", "surrogatepass")) < min_chars:
                        continue
                    row.append(i)
                    at.append(k)
                    hashes.append(xxhash.xxh64_intdigest(chunk) - (1 << 63))
                    inside.append(within[0] if within else None)
                    waiting += 40
                    if with_text:
                        chunks.append(chunk.decode("utf-8", "surrogatepass"))
                        waiting += len(chunk)
                    if waiting >= BYTES_PER_BATCH:
                        yield packed()
                        row, at, hashes, inside, chunks, waiting = [], [], [], [], [], 0
            if row:
                yield packed()

    fields = [T.StructField("id", docs.schema["__pg_id"].dataType), T.StructField("key", T.LongType()), T.StructField("at", T.IntegerType())]
    fields += [T.StructField("h", T.LongType()), T.StructField("within", T.IntegerType())] + [T.StructField("chunk", T.StringType())] * with_text
    return docs.select("__pg_id", "__pg_key", "__pg_text").mapInArrow(cut, T.StructType(fields))


def _small(df: DataFrame, limit: int) -> DataFrame:
    """df marked for broadcast if it is counted to have limit rows or fewer."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _repeats(hashes: DataFrame, texts: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """(id, key, at, first) of the chunks that are not their first occurrence; hashes and texts are _chunk_rows without and with the text."""
    hashes = materialised(hashes)
    repeated = materialised(hashes.groupBy("h").count().where("count > 1").select("h"))
    again = texts.join(_small(repeated, max_broadcast_rows), "h", "left_semi")
    place = F.struct(F.col("id").isNull().alias("n"), "id", "key", "at")
    groups = materialised(again.groupBy("h", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    by_hash = groups.groupBy("h").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n"))
    by_hash = materialised(by_hash.where("n > 1").select("h", "texts", "first"))
    gone = hashes.join(_small(by_hash.where("texts = 1").select("h", "first"), max_broadcast_rows), "h")
    collided = by_hash.where("texts > 1").select("h")
    if not collided.isEmpty():  # different texts with one hash: their occurrences are told apart by their bytes
        exact = texts.join(collided, "h", "left_semi").join(groups.where("n > 1").drop("n"), ["h", "chunk"])
        gone = gone.unionByName(exact.select("h", "id", "key", "at", "first"))
    return gone.where(~place.eqNullSafe(F.col("first"))).select("id", "key", "at", "first")


def _removed(hashes: DataFrame, texts: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """(id, key, ats) of the chunks to remove, by document."""
    return _repeats(hashes, texts, max_broadcast_rows).groupBy("id", "key").agg(F.collect_set("at").alias("ats"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, results: tuple[str, ...]) -> tuple[list[str], DataFrame]:
    """The columns of docs that stay, and docs with __pg_id, __pg_text, __pg_key."""
    kept = [c for c in docs.columns if c not in results]
    text = F.col(text_col).cast("string")
    return kept, in_small_batches(docs).select(*kept, F.col(id_col).alias("__pg_id"), text.alias("__pg_text"), F.xxhash64(text).alias("__pg_key"))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    divisor: int = DIVISOR,
    min_chars: int = MIN_CHARS,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """docs with text_col reduced to what stays, and n_lines, n_chunks, n_removed_chunks, n_removed_lines (of the input)."""
    kept, keyed = _keyed(docs, id_col, text_col, RESULTS)
    narrow = keyed.select("__pg_id", "__pg_text", "__pg_key")
    rows = [_chunk_rows(narrow, lambda text: _chunks(text, window, divisor), min_chars, with_text) for with_text in (False, True)]
    removed = _removed(*rows, max_broadcast_rows).toDF("__pg_i", "__pg_k", "__pg_ats")
    same = F.col("__pg_id").eqNullSafe(F.col("__pg_i")) & (F.col("__pg_key") == F.col("__pg_k"))

    @F.arrow_udf("struct<text:string,n_lines:bigint,n_chunks:bigint,n_removed_chunks:bigint,n_removed_lines:bigint>")
    def staying(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for text, ats in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
            if text is None:
                out.append((None, 0, 0, 0, 0))
                continue
            chunks, gone = _chunks(text, window, divisor), set(ats or ())
            if gone:
                text = b"\n".join(x for k, lines in chunks if k not in gone for x in lines).decode("utf-8", "surrogatepass")
            n = [sum(len(lines) for _, lines in chunks), len(chunks), len(gone), sum(len(lines) for k, lines in chunks if k in gone)]
            out.append((text, *n))
        columns = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, [pa.string(), *[pa.int64()] * 4], strict=True)]
        return pa.StructArray.from_arrays(columns, ["text", *RESULTS])

    done = keyed.join(removed, same, "left").withColumn("__pg_out", staying("__pg_text", "__pg_ats"))
    return done.select(*[F.col("__pg_out.text").alias(c) if c == text_col else F.col(c) for c in kept], *[F.col(f"__pg_out.{c}") for c in RESULTS])


def run_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    window: int = WINDOW,
    divisor: int = DIVISOR,
) -> DataFrame:
    """docs with text_col reduced to the lines that lie in no repeated run, and n_lines, n_removed_lines (of the input)."""
    kept, keyed = _keyed(docs, id_col, text_col, RUN_RESULTS)
    narrow = keyed.select("__pg_id", "__pg_text", "__pg_key")
    rows = [_chunk_rows(narrow, lambda text: _chunks(text, window, divisor), min_chars, with_text) for with_text in (False, True)]
    chunks = materialised(_repeats(*rows, max_broadcast_rows).select("id", "key", "at"))
    hashes, texts = [_chunk_rows(narrow, lambda text: _runs(text, min_chars, window, divisor), min_chars, with_text) for with_text in (False, True)]
    # only numbers are joined
    found = F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & (F.col("within") == F.col("w"))
    around = hashes.join(chunks.toDF("i", "k", "w").hint("merge"), found, "left_anti")
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    runs = _repeats(around, texts, max_broadcast_rows).select("id", "key", F.struct("at", F.when(own, F.col("first.at")).alias("first"), F.lit(False).alias("chunk")).alias("x"))
    whole = chunks.select("id", "key", F.struct("at", F.lit(None).cast("int").alias("first"), F.lit(True).alias("chunk")).alias("x"))
    removed = runs.unionAll(whole).groupBy("id", "key").agg(F.collect_set("x").alias("ats")).toDF("__pg_i", "__pg_k", "__pg_ats")
    same = F.col("__pg_id").eqNullSafe(F.col("__pg_i")) & (F.col("__pg_key") == F.col("__pg_k"))

    @F.arrow_udf("struct<text:string,n_lines:bigint,n_removed_lines:bigint>")
    def staying(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for text, repeats in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
            if text is None:
                out.append((None, 0, 0))
                continue
            lines, gone = text.encode("utf-8", "surrogatepass").split(b"\n"), set()
            runs, spans = (shortest_runs(lines, min_chars), _spans(lines, window, divisor)) if repeats else ([], [])
            for x in repeats or ():
                a, b = (spans if x["chunk"] else runs)[x["at"]]
                if x["first"] is None or runs[x["first"]][1] <= a:
                    gone.update(range(a, b))
            if gone:
                text = b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode("utf-8", "surrogatepass")
            out.append((text, len(lines), len(gone)))
        columns = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 3, [pa.string(), pa.int64(), pa.int64()], strict=True)]
        return pa.StructArray.from_arrays(columns, ["text", *RUN_RESULTS])

    done = keyed.join(removed, same, "left").withColumn("__pg_out", staying("__pg_text", "__pg_ats"))
    return done.select(*[F.col("__pg_out.text").alias(c) if c == text_col else F.col(c) for c in kept], *[F.col(f"__pg_out.{c}") for c in RUN_RESULTS])


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i,
    len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) % 2147483647 AS lh FROM l),
e AS (
  SELECT *, i = n - 1 OR ((coalesce(lag(lh) OVER d, 0) * 31 + lh) % 2147483647) % 3 = 0 AS is_end
  FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c AS (
  SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ck FROM e),
k AS (SELECT doc_id, ck, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, ck),
r AS (
  SELECT *, lines > 1 AND length(chunk) >= 64 AND row_number() OVER (PARTITION BY chunk, lines > 1 ORDER BY doc_id, ck) > 1 AS gone FROM k)
SELECT d.doc_id, CASE WHEN bool_or(gone) THEN coalesce(string_agg(chunk, chr(10) ORDER BY ck) FILTER (NOT gone), '') ELSE any_value(d.text) END AS text,
  CAST(coalesce(sum(lines), 0) AS BIGINT) AS n_lines, count(ck) AS n_chunks, count(ck) FILTER (gone) AS n_removed_chunks,
  CAST(coalesce(sum(lines) FILTER (gone), 0) AS BIGINT) AS n_removed_lines
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""
