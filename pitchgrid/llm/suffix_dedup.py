"""Suffix-array dedup: removes bytes covered by a long string that also starts elsewhere, over a logarithmic index family.

A window is ``WINDOW`` bytes. Its anchor is the k bytes inside it whose hash is least (leftmost among equals), so equal
windows have equal anchors at equal offsets. The suffixes that start at anchors are the index's sample: neighbouring windows
with one anchor form a unit, which is a row of the anchor's first 16 bytes (two big-endian integers, so that their order is
the order of the bytes), its place, and a 128-bit BLAKE2b digest of the unit's bytes.

First, the suffixes that can have a long match are found by an index family (``SuffixIndex``). Texts come in batches. A
batch's suffix array holds its sampled suffixes in the order of their first 16 bytes, equal ones folded to a count. Levels of
the rank that the batch has reached are merged with it, which scans them; it is merge-scanned (a sort-merge join) against the
others. Each batch reports the beginnings that its arrival made repeated. n batches leave about log2(n) levels.

Then only rows with a repeated beginning are compared. Two units of equal content repeat each other's windows. Units of one
anchor but different content may share some of their windows: one of each content is cut anew with longer anchors, and in
the last round with anchors as long as the window, where a unit is a single window. Rounds get smaller by an order of
magnitude; no pair of units is ever formed, so a string in a third of all texts costs one row per text. All counts combine in
the map tasks first and are written, so that adaptive execution can split hot keys of the rows that they join. Bytes are
compared by their BLAKE2b digests: a wrong removal needs a collision of this cryptographic hash.

Defined cases: a null text counts as empty and keeps no bytes; texts shorter than the window never match; a string that
overlaps itself counts; rows equal in id and text repeat each other; rows of one id (null ids too) with different texts are
told apart by the texts' XXH64; a very long text is cut in passes of ``WINDOWS_PER_PASS`` windows; an empty table gives an
empty result; extra columns are kept, those named like a result replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.llm.storage import discard, in_small_batches, materialised

WINDOW = 200
#: Anchor lengths of the rounds; the last is the window.
ANCHORS = (64, 180, WINDOW)
BATCHES = 4
#: Bytes of a suffix by which the index orders it.
PREFIX = 16
#: Windows handled in one numpy pass; bounds the memory that a long text takes.
WINDOWS_PER_PASS = 1 << 20
ROWS_PER_BATCH = 200_000
MAX_BROADCAST_ROWS = 300_000
PLACE_BITS = 26
BASE = 0x9E3779B97F4A7C15
SPANS = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("n", T.IntegerType())]))
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    n, out = WINDOWS_PER_PASS + 4 * WINDOW, []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _anchor_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A well-mixed rolling hash of every k bytes."""
    power, inverse = _powers()
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[k:] - total[: n - k + 1]) * inverse[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _least_places(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes the place of the least, leftmost among equals."""
    keep = np.uint64(PLACE_BITS)
    v = (h >> keep << keep) | np.arange(len(h), dtype=np.uint64)
    blocks = np.concatenate([v, np.full(-len(v) % w, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - w + 1
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def _starts(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The first n bytes, PREFIX at most, at each place, as pairs of integers in the order of the bytes."""
    first = np.zeros((len(at), PREFIX), np.uint8)
    for i in range(min(n, PREFIX)):
        first[:, i] = data[at + i]
    return (first.view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def units(piece: bytes, k: int, window: int = WINDOW, starts: bool = True) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, h, u, lo, n) arrays of the units of a piece: the anchor's first bytes in byte order (None without starts) and
    hash, two integers of the digest, first window, number of windows."""
    windows = len(piece) - window + 1
    for at in range(0, max(windows, 0), WINDOWS_PER_PASS):
        part = piece[at : min(at + WINDOWS_PER_PASS, windows) + window - 1]
        data = np.frombuffer(part, np.uint8)
        h = _anchor_hashes(data, k)
        place = _least_places(h, window - k + 1) if k < window else np.arange(len(h))
        lo = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        n = np.diff(np.concatenate((lo, [len(place)])))
        spans = zip(lo.tolist(), (lo + n + window - 1).tolist(), strict=True)
        u = np.frombuffer(b"".join([blake2b(part[a:b], digest_size=16).digest() for a, b in spans]), np.int64).reshape(-1, 2)
        yield _starts(data, place[lo], k) if starts else None, h[place[lo]].view(np.int64), u, lo + at, n


def _unit_rows(texts: DataFrame, k: int, window: int, starts: bool = True) -> DataFrame:
    """(s1, s2, h, u1, u2, lo, n, id, x) of the units of texts(id, x, text, spans), without s1 and s2 if not starts; null spans: of the whole text."""
    names = [*["s1", "s2"] * starts, "h", "u1", "u2"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list] = [[], [], [], [], [], []]
            waiting = 0

            def packed(batch=batch, held=held) -> pa.RecordBatch:
                h, u, row, lo, n = (np.concatenate(x) for x in held[1:])
                pairs = [np.concatenate(held[0]), u] if starts else [u]
                columns = [pa.array(np.ascontiguousarray(x[:, i])) for x in pairs for i in (0, 1)]
                longs = [*columns[:-2], pa.array(h), *columns[-2:]]
                of = pa.array(row)
                columns = [*longs, pa.array(lo, pa.int32()), pa.array(n, pa.int32()), batch.column(0).take(of), batch.column(1).take(of)]
                return pa.RecordBatch.from_arrays(columns, [*names, "lo", "n", "id", "x"])

            for i in range(batch.num_rows):
                text = (batch.column(2)[i].as_py() or "").encode("utf-8", "surrogatepass")
                spans = batch.column(3)[i].as_py()
                pieces = [(0, text)] if spans is None else [(s["lo"], text[s["lo"] : s["lo"] + s["n"] + window - 1]) for s in spans]
                for base, piece in pieces:
                    for start, h, u, lo, n in units(piece, k, window, starts):
                        for to, x in zip(held, (start, h, u, np.full(len(h), i), lo + base, n), strict=True):
                            to.append(x)
                        waiting += len(h)
                        if waiting >= ROWS_PER_BATCH:
                            yield packed()
                            for x in held:
                                x.clear()
                            waiting = 0
            if waiting:
                yield packed()

    fields = [*[T.StructField(c, T.LongType()) for c in names], *[T.StructField(c, T.IntegerType()) for c in ("lo", "n")]]
    return texts.select("id", "x", "text", "spans").mapInArrow(cut, T.StructType([*fields, texts.schema["id"], texts.schema["x"]]))


class SuffixIndex:
    """A logarithmic family of levels: suffix arrays (s1, s2, n) of how often a suffix with these first bytes occurs.

    Kept between runs, ``levels`` takes later batches: each reports what it repeats of all that came before.
    """

    def __init__(self, levels: list[tuple[int, DataFrame]] | None = None) -> None:
        self.levels = list(levels or [])

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch's suffixes (s1, s2): the beginnings (s1, s2) that occur twice now and did not before, and maybe others that occur twice."""
        merging, rank = [], 0
        while self.levels and self.levels[-1][0] == rank:
            merging.append(self.levels.pop()[1])
            rank += 1
        one, stored = F.lit(1).cast("bigint"), F.col("n")
        rows = [batch.select("s1", "s2", one.alias("n"), F.lit(0).cast("bigint").alias("had"))]
        rows += [t.select("s1", "s2", stored, stored.alias("had")) for t in merging]
        array = reduce(DataFrame.unionByName, rows).groupBy("s1", "s2").agg(F.sum("n").alias("n"), F.max("had").alias("had"))
        array = materialised(array.sortWithinPartitions("s1", "s2"))
        found = array.where("n > 1 and had <= 1").select("s1", "s2")
        for _, level in self.levels:
            met = array.join(level.select("s1", "s2", stored.alias("m")), ["s1", "s2"]).where("n = 1 or m = 1")
            found = found.unionByName(met.select("s1", "s2"))
        found = materialised(found)
        self.levels.append((rank, array.select("s1", "s2", "n")))
        discard(*merging)
        return found

    def drop(self) -> None:
        """Delete the stored levels."""
        discard(*[t for _, t in self.levels])
        self.levels.clear()


def _small(df: DataFrame, limit: int) -> DataFrame:
    """df marked for broadcast if it is counted to have limit rows or fewer; its rows are a few numbers."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _may_repeat(rows: DataFrame, batches: int) -> DataFrame:
    """Those of rows(s1, s2, .., id, x) whose first bytes occur twice or more, by the index family."""
    index = SuffixIndex()
    number = F.pmod(F.xxhash64("id", "x"), F.lit(batches))
    found = [index.add(rows.where(number == b)) for b in range(batches)]
    again = materialised(reduce(DataFrame.unionByName, found).distinct())
    out = materialised(rows.join(again, ["s1", "s2"]).drop("s1", "s2"))
    index.drop()
    discard(rows, again, *found)
    return out


def _matched(rows: DataFrame, last: bool, limit: int) -> DataFrame:
    """rows whose content occurs twice (dup) or whose anchor has different contents (mixed)."""
    unit = ["h", "u1", "u2"]
    counts = rows.groupBy(*unit).agg(F.count("*").alias("c")).select(*unit, (F.col("c") > 1).alias("dup"))
    if last:
        flags = counts.where("dup").withColumn("mixed", F.lit(False))
    else:
        counts = materialised(counts)
        several = (F.min("u1") < F.max("u1")) | (F.min("u2") < F.max("u2"))
        mixed = materialised(counts.groupBy("h").agg(several.alias("mixed")).where("mixed"))
        flags = counts.join(_small(mixed, limit), "h", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False))).where("dup or mixed")
    return materialised(rows.join(materialised(flags), unit))


def _only(texts: DataFrame, marked: DataFrame, limit: int, how: str = "left_semi") -> DataFrame | None:
    """texts without (or with how=left_anti: only) those that are surely not in marked(id, x); None beyond limit rows of marked.

    The hash of (id, x) decides, so what is broadcast is limit long integers at most.
    """
    of = F.xxhash64("id", "x").alias("y")
    hashes = marked.select(of).distinct()
    if hashes.limit(limit + 1).count() > limit:
        return None
    return texts.withColumn("y", of).join(F.broadcast(hashes), "y", how).drop("y")


def repeated_spans(texts: DataFrame, window: int = WINDOW, anchors: tuple[int, ...] = ANCHORS, batches: int = BATCHES, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(id, x, spans): merged byte spans (lo, n) of texts(id, x, text) to remove; texts without any are left out."""
    if anchors[-1] != window:
        raise ValueError("the last anchor must be as long as the window")
    whole = texts.where(F.octet_length("text") >= window)
    marked, found = whole.withColumn("spans", F.lit(None).cast(SPANS)), []
    for step, k in enumerate(anchors):
        rows, last = materialised(_unit_rows(marked, k, window, starts=step == 0)), step == len(anchors) - 1
        rows = _may_repeat(rows, batches) if step == 0 else rows
        matched = _matched(rows, last, limit)
        discard(rows)
        found.append(matched.where("dup").select("id", "x", "lo", (F.col("n") + window - 1).alias("n")))
        if last:
            break
        # one unit of each content whose anchor has others
        one = matched.where("mixed").groupBy("h", "u1", "u2").agg(F.min(F.struct("id", "x", "lo", "n")).alias("s")).select("s.*")
        lists = materialised(one.groupBy("id", "x").agg(F.collect_list(F.struct("lo", "n")).alias("spans")))
        some = _only(whole, lists, limit)
        some = whole if some is None else some
        same = F.col("id").eqNullSafe(F.col("__pg_i")) & (F.col("x") == F.col("__pg_x"))
        marked = some.join(lists.toDF("__pg_i", "__pg_x", "spans"), same).select("id", "x", "text", "spans")
    spans = reduce(DataFrame.unionByName, found).groupBy("id", "x").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    return materialised(spans.select("id", "x", _merged("spans").alias("spans")))


@F.arrow_udf(SPANS)
def _merged(spans: pa.Array) -> pa.Array:
    """The union of each list of spans."""
    out = []
    for s in spans.to_pylist():
        runs: list[list[int]] = []
        for lo, n in sorted((x["lo"], x["n"]) for x in s):
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], lo + n)
            else:
                runs.append([lo, lo + n])
        out.append([{"lo": a, "n": b - a} for a, b in runs])
    return pa.array(out, pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int32())])))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """docs with text_col replaced by ``kept`` (binary, the bytes that stay), and n_bytes, n_removed, n_spans."""
    kept = [c for c in docs.columns if c not in RESULTS]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = in_small_batches(docs).select(*[F.col(c).alias(f"__pg_c_{c}") for c in kept if c != text_col], F.col(id_col).alias("id"), text.alias("text"))
    keyed = keyed.withColumn("x", F.xxhash64("text"))
    anchors = tuple(round(a * window / WINDOW) for a in ANCHORS)
    spans = repeated_spans(keyed.select("id", "x", "text"), window, anchors, batches, limit)
    some, others = _only(keyed, spans, limit), _only(keyed, spans, limit, "left_anti")
    some = keyed if some is None else some
    found = spans.toDF("__pg_i", "__pg_x", "spans")
    joined = some.join(found, F.col("id").eqNullSafe(F.col("__pg_i")) & (F.col("x") == F.col("__pg_x")), "left").drop("__pg_i", "__pg_x")
    if others is not None:
        joined = joined.unionByName(others.withColumn("spans", F.lit(None).cast(SPANS)))

    @F.arrow_udf("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>")
    def stay(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out: list[list] = [[], [], [], []]
        for text, cut in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            data, at, parts = text.encode("utf-8", "surrogatepass"), 0, []
            for s in cut or ():
                parts.append(data[at : s["lo"]])
                at = s["lo"] + s["n"]
            left = b"".join([*parts, data[at:]])
            for to, x in zip(out, (len(data), len(data) - len(left), len(cut or ()), left), strict=True):
                to.append(x)
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(out, [*[pa.int64()] * 3, pa.binary()], strict=True)], list(RESULTS))

    done = joined.withColumn("__pg_out", stay("text", "spans"))
    return done.select(*[F.col(f"__pg_c_{c}").alias(c) for c in kept if c != text_col], *[F.col(f"__pg_out.{c}") for c in RESULTS])


def dedup_digests(deduped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sizes and the digest of the kept bytes, by document."""
    return deduped.select(F.col(id_col).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
