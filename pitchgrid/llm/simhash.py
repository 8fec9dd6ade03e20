"""SimHash near-duplicates by multi-index hashing.

A text (ASCII letters lower-cased) is a sequence of words ``[^\\x20\\x09-\\x0D]+``; the XXH64 (seed 42) of its 3-word
shingles vote on 64 bits. Two fingerprints that differ in at most 3 bits agree up to at most 1 bit in one of their two
32-bit halves. So each distinct fingerprint is stored once per half; each enumerates the ball of radius 1 around each
half (33 values), fetches the table's matches and verifies the whole distance. The table and the probes grow in
proportion to the distinct fingerprints; equal fingerprints are linked through one representative.

Defined cases: null or wordless texts have fingerprint 0 and are linked like any other; a text of fewer than three words
has its whole word sequence as its only shingle; rows with one doc_id in common share a node; rows with a null doc_id are
fingerprinted but belong to no component (null); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.llm.components import connected_components
from pitchgrid.llm.storage import in_small_batches, materialised

SEED, SHINGLE, MAX_DISTANCE, BITS = 42, 3, 3, 64
MAX_BROADCAST_ROWS = 1_000_000
#: Shingle hashes counted together in one numpy pass; bounds memory on long texts.
HASHES_PER_PASS = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(line)]))
    if len(words) >= SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, votes = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), HASHES_PER_PASS):
        spans = zip(starts[at : at + HASHES_PER_PASS].tolist(), ends[at : at + HASHES_PER_PASS].tolist(), strict=True)
        packed = np.frombuffer(b"".join([digest(line[s:e], SEED) for s, e in spans]), np.uint8).reshape(-1, 8)
        votes += np.unpackbits(packed, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big", signed=True)


@F.arrow_udf(T.LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(x) for x in text.to_pylist()], pa.int64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed bigint."""
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col).cast("string")).alias("fp"))


def links(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(u, v) for each pair of nodes(rep, fp) with distinct fp at most max_distance bits apart, at most 3."""
    if not 0 <= max_distance <= 3:
        raise ValueError("two halves with balls of radius 1 find distances up to 3")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), low.alias("value")), F.struct(F.lit(1).alias("half"), high.alias("value"))))
    table = nodes.select("rep", "fp", halves.alias("s")).select("rep", "fp", "s.half", "s.value")
    ball = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << k).cast("bigint") for k in range(32)])
    probes = table.select("rep", "fp", "half", "value", F.explode(ball).alias("flip")).select(
        F.col("rep").alias("u"), F.col("fp").alias("fu"), "half", F.col("value").bitwiseXOR(F.col("flip")).alias("value")
    )
    distance = F.bit_count(F.col("fu").bitwiseXOR(F.col("fp")))
    # after an explode Spark takes a side for as small as before it, and might broadcast 66 rows for each of a small table
    near = probes.hint("merge").join(table.hint("merge"), ["half", "value"]).where((F.col("u") > F.col("rep")) & (distance <= max_distance))
    return near.select("u", F.col("rep").alias("v"))


def components_of(prints: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """prints(doc_id, fp) with component_id: the smallest doc_id reachable over equal fp, equal doc_id and linked(u, v) of nodes(fp, rep)."""
    with_id = prints.where("doc_id is not null")
    shared = with_id.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    one_id = (
        with_id.join(shared.select("doc_id"), "doc_id").join(nodes.hint("merge"), "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    )
    parts = connected_components(linked.unionAll(one_id))
    found = nodes.join(parts.hint("merge"), nodes.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return prints.join(found.hint("merge"), "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    component_id is the smallest doc_id reachable over links between fingerprints 3 or fewer bits apart.
    """
    prints = materialised(fingerprints(docs, id_col, text_col))
    nodes = materialised(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components_of(prints, nodes, links(nodes))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """docs with one row of each component: the row of its smallest id, once; rows with a null id stay."""
    return keep_smallest(docs, near_duplicates(docs, id_col, text_col), id_col, max_broadcast_rows)


def keep_smallest(docs: DataFrame, classes: DataFrame, id_col: str, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """docs with the row of the smallest id of each component of classes(doc_id, component_id), once; rows with a null id stay."""
    gone = materialised(classes.where("component_id <> doc_id").select(F.col("doc_id").alias("__pg_gone")).distinct())
    if gone.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        gone = F.broadcast(gone)
    kept = docs.join(gone, F.col(id_col) == F.col("__pg_gone"), "left_anti")
    repeated = docs.groupBy(F.col(id_col).alias("__pg_id")).count().where("count > 1 and __pg_id is not null").select("__pg_id")
    if repeated.isEmpty():
        return kept
    repeated = materialised(repeated)
    # of the rows of one id the least by their JSON, which any column type has
    row = F.struct(*docs.columns)
    once = kept.join(repeated, F.col(id_col) == F.col("__pg_id"), "left_semi").groupBy(F.col(id_col).alias("__pg_id")).agg(F.min_by(row, F.to_json(row)).alias("__pg_r"))
    once = once.select("__pg_r.*")
    return kept.join(repeated, F.col(id_col) == F.col("__pg_id"), "left_anti").unionByName(once)
