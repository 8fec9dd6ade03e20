"""Merkle manifest of a dataset, reduced by superblocks.

Every row is a leaf: the SHA-256 of its columns' lengths and values. Leaves ascend by id within their group; ``fanout``
consecutive nodes become the digest of their digests' hexadecimal text, until one is left (the subroot). Subroots, ordered
by group, give the root the same way.

A tree is reduced a superblock at a time: leaves are bucketed by place div ``fanout ** levels``, so a bucket has so many rows
at most however large its group is, and one ``applyInPandas`` call collapses all its levels. It gives each row the siblings
on the way to the bucket's root (the lower proof); bucket roots are the leaves of the next round. Proofs are put together
from the top: a row's is its lower proof and that of its bucket, which joins by (group, bucket). With a fanout of 2 and 10
levels, a hundred thousand million rows take four rounds, each on a table a thousand times smaller.

Places need the rows in order without a window by group, as one group may hold most rows: the digests are written, dealt by
ranges of (group, id), and written with their place in their range. Counts by range and group, as many as ranges and groups,
give the rest. Texts are read once and never shuffled.

Defined cases: null columns count as ``-``; a null group comes first and is a group of its own; null ids come first in their
group; rows with the same id ascend by their leaf; repeated rows are a leaf each; groups and ids of any type are ordered by
their own type, groups as text; very long texts are hashed in the JVM; a group of one row has its leaf as subroot; an empty
table gives an empty result. Columns other than those named have no effect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.llm.storage import discard, materialised

FANOUT, LEVELS = 2, 10
#: Columns of documents that a leaf covers.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tampered rows of the query: those whose id's CRC-32 it divides.
TAMPER = 7


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns' values, each ``-`` if null, else its length in UTF-8 bytes, a colon and its text."""
    texts = [c.cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def joined_digest(digests: list[bytes]) -> bytes:
    """The digest of a run of nodes."""
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


def fold(digest: bytes, place: int, n: int, siblings: Iterator[bytes], fanout: int = FANOUT) -> bytes:
    """The root of a tree of n leaves, from the digest of the leaf at a place and the siblings on its way, which are used up."""
    while n > 1:
        first = place // fanout * fanout
        others = [next(siblings) for _ in range(min(fanout, n - first) - 1)]
        digest = joined_digest([*others[: place - first], digest, *others[place - first :]])
        place, n = place // fanout, -(-n // fanout)
    return digest


def collapse(nodes: list[bytes], n: int, fanout: int, levels: int) -> tuple[bytes, list[bytes]]:
    """(root, proofs) of consecutive nodes, the first at a multiple of fanout ** levels in a tree of n, after so many levels at most."""
    proofs, width = [[] for _ in nodes], 1
    while n > 1 and levels:
        others = [b"".join(nodes[q // fanout * fanout : q]) + b"".join(nodes[q + 1 : (q // fanout + 1) * fanout]) for q in range(len(nodes))]
        for j, proof in enumerate(proofs):
            proof.append(others[j // width])
        nodes = [joined_digest(nodes[q : q + fanout]) for q in range(0, len(nodes), fanout)]
        n, levels, width = -(-n // fanout), levels - 1, width * fanout
    return nodes[0], [b"".join(p) for p in proofs]


def _superblock(fanout: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("i", ignore_index=True)
        root, proofs = collapse(block["digest"].tolist(), int(block["n"][0]), fanout, levels)
        return block.assign(proof=proofs, top=[root, *[None] * (len(block) - 1)])

    return reduce


def _reduced(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds (g, b, i, n, digest, proof, top) from the leaves up, and the roots (g, digest) of nodes(g, i, n, digest)."""
    rounds, span = [], fanout**levels
    schema = "g long, b long, i long, n long, digest binary, proof binary, top binary"
    while True:
        bucketed = nodes.select("g", F.expr(f"i div {span}").alias("b"), "i", "n", "digest")
        rounds.append(materialised(bucketed.groupBy("g", "b").applyInPandas(_superblock(fanout, levels), schema)))
        tops = rounds[-1].where("top is not null")
        nodes = tops.select("g", F.col("b").alias("i"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("top").alias("digest"))
        if (tops.agg(F.max("n")).first()[0] or 0) <= span:
            return rounds, nodes.select("g", "digest")


def _proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, i, proof, others of above) of every leaf; above(g, proof, others) has what lies over each tree's root."""
    others = [F.col(f"a.{c}") for c in above.columns if c not in ("g", "proof")]
    above = above.withColumn("i", F.lit(0).cast("long"))
    for r in reversed(rounds):
        at = (F.col("r.g") == F.col("a.g")) & (F.col("r.b") == F.col("a.i"))
        above = r.alias("r").join(above.alias("a"), at).select("r.g", "r.i", F.concat("r.proof", "a.proof").alias("proof"), *others)
    return above


def _placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with i, their place within key, and n, the key's rows; and (key, n) of every key. rows has key, never null."""
    tied = materialised(rows.withColumn("tie", F.monotonically_increasing_id()))
    by = [F.col(c).asc_nulls_first() for c in ("key", *order, "tie")]
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # what is left of the range's own bits
    ranged = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    ranged = materialised(ranged.withColumns({"range": F.spark_partition_id(), "at": in_range}))
    discard(tied)
    sizes = materialised(ranged.groupBy("key", "range").agg(F.min("at").alias("first"), F.count("*").alias("k")))
    before = F.coalesce(F.sum("k").over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("key", "range", (before - F.col("first")).alias("shift"), F.sum("k").over(W.partitionBy("key")).alias("n"))
    placed = ranged.join(sizes, ["key", "range"]).withColumn("i", F.col("at") + F.col("shift")).drop("range", "at", "shift")
    return placed, sizes.select("key", "n").distinct()


def manifest(rows: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(id, carried columns, leaf, i, n, g, groups, proof, subroot, root) of every row.

    i is the place among the n rows of the row's group, g the group's place among the groups; proof has the digests of the
    siblings from the leaf to the root, 32 bytes each. Digests are binary; leaf is a column of rows that gives one.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("a run has two nodes or more, a superblock one level or more")
    carry = carry or {}
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = rows.select(F.col(id_col).alias("id"), key.alias("key"), leaf.alias("leaf"), *[c.alias(f"c_{name}") for name, c in carry.items()])
    placed, keys = _placed(rows, ["id", "leaf"])
    groups, _ = _placed(keys.select(F.lit("").alias("key"), F.col("key").alias("group")), ["group"])
    groups = groups.select(F.col("group").alias("key"), F.col("i").alias("g"), F.col("n").alias("groups"))
    placed = materialised(placed.join(materialised(groups), "key").drop("key"))

    lower, subroots = _reduced(placed.select("g", "i", "n", F.col("leaf").alias("digest")), fanout, levels)
    subroots = materialised(subroots.join(groups, "g").select("g", "groups", F.col("digest").alias("subroot")))
    upper, root = _reduced(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.col("groups").alias("n"), F.col("subroot").alias("digest")), fanout, levels)
    root = root.select("g", F.lit(b"").alias("proof"), F.col("digest").alias("root"))
    above = _proofs(upper, root).select(F.col("i").alias("g"), "proof", "root").join(subroots.drop("groups"), "g")
    out = placed.join(_proofs(lower, above), ["g", "i"])
    return out.select(F.col("id").alias(id_col), *[F.col(f"c_{c}").alias(c) for c in carry], "leaf", "i", "n", "g", "groups", "proof", "subroot", "root")


def folded_root(leaf: Column, fanout: int = FANOUT) -> Column:
    """The root that a leaf's digest and the proof of its row of a manifest give, binary."""

    @F.arrow_udf(T.BinaryType())
    def folded(leaf: pa.Array, i: pa.Array, n: pa.Array, g: pa.Array, groups: pa.Array, proof: pa.Array) -> pa.Array:
        out = []
        for d, *places, p in zip(*[x.to_pylist() for x in (leaf, i, n, g, groups, proof)], strict=True):
            siblings = (p[k : k + 32] for k in range(0, len(p), 32))
            out.append(fold(fold(d, places[0], places[1], siblings, fanout), places[2], places[3], siblings, fanout))
        return pa.array(out, pa.binary())

    return folded(leaf, "i", "n", "g", "groups", "proof")


def tampering_digests(docs: DataFrame) -> DataFrame:
    """The query's columns of every row of documents: its proof folded from the leaf, or from a leaf that was tampered with."""
    columns = {c: F.col(c) for c in COLUMNS}
    hit = (F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0) & F.col("n_chars").isNotNull()
    changed = leaf_digest([*(columns | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}).values()])
    rows = manifest(docs, leaf_digest([*columns.values()]), carry={"changed": F.when(hit, changed)})
    rows = rows.withColumn("folded", folded_root(F.coalesce("changed", "leaf")))
    shown = [F.lower(F.hex(a)).alias(b) for a, b in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"))]
    proof = F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256")
    return rows.select("doc_id", *shown, proof, F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in COLUMNS) + ")"
_CHANGED = "sha256(" + " || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in COLUMNS) + ")"
#: CRC-32 of an id's digits: a byte is folded in, then eight steps of the polynomial follow.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
  lambda k: list_prepend(ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT, list_transform(range(8), lambda z: -1::BIGINT))))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END)"""

#: Levels by recursion: nodes of a level are grouped in pairs until one is left, and a row's fold joins them level by level.
ORACLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN xor({_CRC}, 4294967295::BIGINT) % {TAMPER} = 0 AND n_chars IS NOT NULL THEN {_CHANGED} ELSE {_LEAF} END AS own,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM documents),
t AS (SELECT g, i, n, leaf AS d, 0 AS lev FROM leaves
      UNION ALL SELECT g, i // 2, max((n + 1) // 2), sha256(string_agg(d, '' ORDER BY i)), max(lev) + 1 FROM t WHERE n > 1 GROUP BY g, i // 2),
subs AS (SELECT g, d, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT g AS i, n, d, 0 AS lev FROM subs
      UNION ALL SELECT i // 2, max((n + 1) // 2), sha256(string_agg(d, '' ORDER BY i)), max(lev) + 1 FROM u WHERE n > 1 GROUP BY i // 2),
f AS (SELECT doc_id, g, i, n, 0 AS lev, own AS d, '' AS proof FROM leaves
      UNION ALL SELECT f.doc_id, f.g, f.i // 2, (f.n + 1) // 2, f.lev + 1,
        sha256(CASE WHEN s.d IS NULL THEN f.d WHEN f.i % 2 = 0 THEN f.d || s.d ELSE s.d || f.d END), f.proof || coalesce(s.d, '')
      FROM f LEFT JOIN t s ON s.g = f.g AND s.lev = f.lev AND s.i = xor(f.i, 1) WHERE f.n > 1),
h AS (SELECT f.doc_id, f.g, f.g AS i, subs.n, 0 AS lev, f.d, f.proof FROM f JOIN subs USING (g) WHERE f.n = 1
      UNION ALL SELECT h.doc_id, h.g, h.i // 2, (h.n + 1) // 2, h.lev + 1,
        sha256(CASE WHEN s.d IS NULL THEN h.d WHEN h.i % 2 = 0 THEN h.d || s.d ELSE s.d || h.d END), h.proof || coalesce(s.d, '')
      FROM h LEFT JOIN u s ON s.lev = h.lev AND s.i = xor(h.i, 1) WHERE h.n > 1)
SELECT l.doc_id, l.leaf, subs.d AS subroot, r.d AS root, sha256(h.proof) AS proof_sha256, h.d AS folded_root, h.d = r.d AS verified
FROM leaves l JOIN h ON h.doc_id = l.doc_id AND h.n = 1 JOIN subs ON subs.g = l.g CROSS JOIN (SELECT d FROM u WHERE n = 1) r
"""
