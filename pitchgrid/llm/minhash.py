"""MinHash near-duplicates by one-permutation hashing, bands and stars.

A text (ASCII letters lower-cased) is the set of the XXH64 (seed 42) of its shingles of four words. One permutation, the
order of the hashes, is cut into ``BANDS * ROWS`` bins, of which each keeps its smallest hash. An empty bin borrows from a
full one that a 2-universal hash of the bin and the attempt picks (optimal densification), so that bins agree with the
probability of the sets' Jaccard similarity however few shingles there are. ``ROWS`` bins make a band, the key of a bucket.
Two sets of similarity 4/5 share no bucket with a probability of (1 - 0.8**ROWS)**BANDS, about 1e-11; a link is lost then
only, and only if no chain of other links connects the two.

A bucket gives stars, not pairs: each of its members against one centre. Parity bitmaps (see ``near_copies``) and sizes
rule out what can't be similar, and the others' whole sets are compared. Linked members have one label then, and buckets
with one label are done. The others get stars with another centre, as long as a round links a hundredth of their members.
What is left are the pairs between labels in the open buckets: they are compared by bitmap in blocks of ``BLOCK`` members,
and only those that the bitmaps allow leave the join. No bucket is capped.

Equal sets are one node, so exact copies cost nothing but their row.

Defined cases: null, empty or wordless texts have no shingles and are linked with nothing, not even through a repeated id; a
text of fewer than four words has its word sequence as its only shingle; rows with one id in common share a node; rows with a
null id are counted but belong to no component (null); very long texts are worked on whole; ties go to the smallest id; an
empty table gives an empty result; columns other than the id and the text have no effect.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.llm.components import connected_components
from pitchgrid.llm.near_copies import BUCKETS, shingles
from pitchgrid.llm.simhash import MAX_BROADCAST_ROWS
from pitchgrid.llm.storage import discard, in_small_batches, materialised

SHINGLE, ROWS, BANDS = 4, 5, 64
BINS = ROWS * BANDS
#: Rounds of stars at most before the open buckets' pairs; members of an open bucket that are compared with each other at a time.
STARS, BLOCK = 30, 512
#: Attempts of a bin to find a full one by hashing; the next full bin serves after that.
ATTEMPTS = 1024
MERSENNE = (1 << 61) - 1
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def _probes() -> np.ndarray:
    """[bin, attempt]: the bin that a 2-universal hash picks."""
    ab = [[xxhash.xxh64_intdigest(f"{c}{j}", 1) % MERSENNE for j in range(ATTEMPTS)] for c in "ab"]
    return np.array([[((a * i + b) % MERSENNE) % BINS for a, b in zip(*ab, strict=True)] for i in range(BINS)], np.int16)


PROBES = _probes()


def sketch(s: np.ndarray) -> np.ndarray:
    """The hash in each bin of a non-empty ascending set, empty bins densified."""
    place = ((s.view(np.uint64) & np.uint64(0xFFFFFFFF)) * np.uint64(BINS)) >> np.uint64(32)
    bins, first = np.unique(place.astype(np.int64), return_index=True)
    full, out = np.zeros(BINS, bool), np.zeros(BINS, np.int64)
    full[bins], out[bins] = True, s[first]
    empty = np.flatnonzero(~full)
    for width in (32, ATTEMPTS):
        hit = full[PROBES[empty, :width]]
        found = hit.any(axis=1)
        out[empty[found]] = out[PROBES[empty[found], hit[found].argmax(axis=1)]]
        empty = empty[~found]
        if not len(empty):
            return out
    out[empty] = out[bins[np.searchsorted(bins, empty) % len(bins)]]
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key a band, which has the band's number in it."""
    values = sketch(s).view(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(MIX[0])
    for j in range(ROWS):
        key = (key ^ values[:, j]) * np.uint64(MIX[1])
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


PRINT = T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("n", T.IntegerType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("odd", "keys")]])


@F.arrow_udf(PRINT)
def _prints(text: pa.Array) -> pa.Array:
    out = []
    for x in text.to_pylist():
        s = shingles(x, SHINGLE)
        if not len(s):
            out.append((None, 0, None, None))
            continue
        odd = np.packbits(np.bincount(s & (BUCKETS - 1), minlength=BUCKETS).astype(np.uint8) & 1).view(np.int64)
        out.append((md5(s.tobytes(), usedforsecurity=False).digest(), len(s), odd, band_keys(s)))
    kinds = (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], ["fp", "n", "odd", "keys"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sets(text: pa.Array) -> pa.Array:
    return pa.array([shingles(x, SHINGLE) for x in text.to_pylist()], pa.list_(pa.int64()))


def _possible(a: str, b: str):
    """Whether sizes and bitmaps allow sets a and b, columns with n and odd, a similarity of 4/5: nine times their symmetric difference is at most the sum of sizes."""
    apart = sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(BUCKETS // 64)), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (n * 5 >= m * 4) & (m * 5 >= n * 4) & (apart * 9 <= n + m)


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (u, v) whose whole sets have 100 * intersection >= 80 * union; docs has doc_id, t."""
    pairs = materialised(pairs)
    ids = materialised(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct())
    few = ids.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    found = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = materialised(found.select("doc_id", _sets("t").alias("s")).distinct())
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    common, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    out = materialised(both.where((common > 0) & (common * 100 >= (total - common) * 80)).select("u", "v").distinct())
    discard(pairs, ids, sets)
    return out


def _labelled(members: DataFrame, linked: DataFrame) -> DataFrame:
    """members of the buckets that still have several labels, with a new label c."""
    parts = connected_components(linked).select(F.col("node").alias("u"), F.col("component").alias("c"))
    members = materialised(members.drop("c").join(parts, "u", "left").withColumn("c", F.coalesce("c", "u")))
    open_ = members.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("k")).where("a <> b").select("key", "k")
    return materialised(members.drop("k").join(open_, "key"))


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v) that connect all nodes(rep, n, odd, keys) which share a bucket and are similar enough; docs has doc_id, t."""
    table = nodes.select(F.explode("keys").alias("key"), F.col("rep").alias("u"))
    shared = materialised(table.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"))
    members = materialised(table.join(shared, "key").withColumn("c", F.col("u")))
    facts = nodes.select(F.col("rep").alias("u"), F.struct("n", "odd").alias("x"))
    linked: DataFrame | None = None
    for i in range(STARS):
        at = F.struct(F.lit(0) if i == 0 else F.xxhash64("u", F.lit(i)), "u")  # the smallest id first, then any
        centre = members.groupBy("key").agg(F.min_by(F.struct("u", "c"), at).alias("z"))
        star = members.join(centre, "key").where("c <> z.c").select(F.greatest("u", "z.u").alias("u"), F.least("u", "z.u").alias("v")).distinct()
        star = star.join(facts, "u").withColumnRenamed("x", "a").join(facts.toDF("v", "b"), "v").where(_possible("a", "b"))
        new = _confirmed(star.select("u", "v"), docs)
        linked = new if linked is None else linked.unionAll(new)
        members = _labelled(members, linked)
        if new.count() * 100 < members.count():
            break
    if members.isEmpty():
        return linked
    block = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")
    rows = members.join(facts, "u").withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int"))
    left = rows.select("key", block.alias("part"), F.struct("u", "c", "x").alias("l"))
    right = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.struct("u", "c", "x").alias("r"))
    across = (F.col("l.u") > F.col("r.u")) & (F.col("l.c") != F.col("r.c")) & _possible("l.x", "r.x")
    rest = left.join(right, ["key", "part"]).where(across).select(F.col("l.u").alias("u"), F.col("r.u").alias("v")).distinct()
    return linked.unionAll(_confirmed(rest, docs))


def _node_components(filled: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, component_id) of every node, over linked(u, v) and rows of filled(doc_id, fp) with one id and several sets."""
    several = filled.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    one_id = filled.join(several, "doc_id").join(nodes.select("fp", "rep"), "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    parts = connected_components(linked.unionAll(one_id))
    return nodes.join(parts, nodes.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def minhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs: the smallest doc_id reachable over links, and whether it is the row's own."""
    texts = in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    prints = materialised(texts.select("doc_id", _prints("t").alias("p")).select("doc_id", "p.*"))
    same = [F.first(c).alias(c) for c in ("n", "odd", "keys")]
    nodes = materialised(prints.where("doc_id is not null and fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), *same))
    filled = prints.where("fp is not null").select("doc_id", "fp", "n")
    out = filled.join(_node_components(filled, nodes, links(nodes, texts)), "fp", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = out.unionAll(prints.where("fp is null").select("doc_id", "n", "doc_id"))
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


#: All pairs that share a shingle, counted; then the smallest id is handed on until nothing changes.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END) AS x FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e USING (u)),
m AS (SELECT u, min(c) AS c FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN m ON m.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
