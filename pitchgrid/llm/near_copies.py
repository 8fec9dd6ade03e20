"""Near copies: SimHash first, and the exact Jaccard similarity of word shingles for every link.

Each text has the SimHash fingerprint of ``simhash``; each fingerprint's neighbours within 3 bits are found by its halves'
balls, and each text is checked against the one with the smallest id among those with its fingerprint and among its
neighbours. That joins most copies. Similar texts may differ in more bits, so a prefix search over shingles follows, which
leaves out pairs that SimHash has joined already. A link of either is a pair of whole sets that are similar enough.

A text (ASCII letters lower-cased) is the set of the XXH64 (seed 42) of its 5-word shingles. Two texts are linked if their
sets have a Jaccard similarity of 4/5 or more. In any order of all shingles, the first that two sets so similar have in
common is among the first ``n - ceil(4 n / 5) + 1`` of each (the prefix), since a fifth of a set at most is not in the other.
The order is by hash, so the first m shingles are no random fifth with a probability of 1 - (1/5)**m: a prefix ends where a
pair is missed with a probability of ``MISS`` at most, and texts of some 110 words or fewer keep their whole prefix.

Of the pairs with a shingle in common in their prefixes, sizes, places and parity bitmaps rule out what cannot be similar: a
set's bitmap holds for each of 512 buckets whether its shingles in it are odd in number, so two bitmaps differ in no more
bits than there are shingles in one set alone. Only the others' whole sets are compared.

Tables of the size of the nodes, of pairs or of prefixes are sorted and merged: Spark takes exploded arrays and repeated
values in files for far less than they are in the driver's memory. Only what is counted to be ``FEW`` rows or fewer is broadcast.

The order takes popular shingles last, so that a common passage makes few candidates, and prefixes are longer by the share
of a text's popular shingles; popularity is counted on a sample of the texts, which changes costs but no result. Of the texts with a shingle in common each is first checked against the one
with the smallest id, unless both are joined; then all pairs but those joined by then are. So a group of near copies of one text costs
checks in proportion to its size. Equal sets are one node.

Defined cases: as for SimHash; null or wordless texts have the empty set and are equal; a text of fewer than five words has
its whole word sequence as its only shingle.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.llm import simhash
from pitchgrid.llm.components import connected_components
from pitchgrid.llm.simhash import MAX_BROADCAST_ROWS, SEED, components_of, keep_smallest
from pitchgrid.llm.storage import in_small_batches, materialised

SHINGLE = 5
#: One text in so many is read for popular shingles: those that occur in so many texts of the sample; at most so many.
SAMPLE, POPULAR, MAX_POPULAR = 16, 4, 200_000
#: Buckets of a parity bitmap.
BUCKETS = 512
#: Rows of numbers that are broadcast at most.
FEW = 100_000
#: Probability that a prefix leaves out the first common shingle of a pair.
MISS = 1e-15


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles of so many words in ascending order, as signed integers."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
    starts, ends = [0, *(i + 1 for i in gaps)], [*gaps, len(line)]
    last = max(1, len(words) - size + 1)
    spans = zip(starts[:last], ends[min(size, len(words)) - 1 :], strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in spans), np.uint64, last).view(np.int64))


def prefix_length(n: int, popular: int, miss: float | None = MISS) -> int:
    """How many of the first shingles of a set of n, popular of them popular and thus last, find its similar sets.

    miss is the probability that a pair is missed; with None or 0 the prefix is whole and none is.
    """
    whole = n - (4 * n + 4) // 5 + 1
    if not miss:
        return whole
    apart = n / (5 * (n - popular)) if popular < n else 1.0  # at most so many of the others are not in a similar set
    return whole if apart >= 1 else min(whole, math.ceil(math.log(miss) / math.log(apart)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _shingles(text: pa.Array) -> pa.Array:
    return pa.array([shingles(x) for x in text.to_pylist()], pa.list_(pa.int64()))


def _popular(texts: DataFrame) -> np.ndarray:
    """Shingles that many texts of a sample hold, in ascending order; texts has t."""
    sample = texts.where(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0).select(F.explode(_shingles("t")).alias("s"))
    many = sample.groupBy("s").count().where(F.col("count") >= POPULAR).orderBy(F.desc("count"), "s").limit(MAX_POPULAR)
    return np.sort(np.array([r.s for r in many.select("s").collect()], np.int64))


def _prints(docs: DataFrame, popular: np.ndarray, miss: float | None = MISS) -> DataFrame:
    """(doc_id, fp, sim, n, odd, prefix): a digest of the set, the text's SimHash, the set's size, parity bitmap and prefix; docs has doc_id, t."""

    @F.arrow_udf("struct<fp:binary,sim:bigint,n:int,odd:array<bigint>,prefix:array<bigint>>")
    def prints(text: pa.Array) -> pa.Array:
        fps, sims, sizes, odds, prefixes = [], [], [], [], []
        for x in text.to_pylist():
            sims.append(simhash.fingerprint(x))
            s = shingles(x)
            n = len(s)
            fps.append(md5(s.tobytes(), usedforsecurity=False).digest())
            sizes.append(n)
            odds.append(np.packbits(np.bincount(s & (BUCKETS - 1), minlength=BUCKETS).astype(np.uint8) & 1).view(np.int64))
            n_late = 0
            if n and len(popular):
                late = popular[np.minimum(np.searchsorted(popular, s), len(popular) - 1)] == s
                s, n_late = np.concatenate((s[~late], s[late])), int(late.sum())
            prefixes.append(s[: prefix_length(n, n_late, miss)])
        columns = [pa.array(fps, pa.binary()), pa.array(sims, pa.int64()), pa.array(sizes, pa.int32()), *[pa.array(x, pa.list_(pa.int64())) for x in (odds, prefixes)]]
        return pa.StructArray.from_arrays(columns, ["fp", "sim", "n", "odd", "prefix"])

    return docs.select("doc_id", prints("t").alias("p")).select("doc_id", "p.*")


def _light(df: DataFrame, few: bool) -> DataFrame:
    """df marked to be broadcast if it has few rows, else to be sorted and merged."""
    return F.broadcast(df) if few else df.hint("merge")


def _few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def _similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the candidate pairs (u, v) whose texts are similar enough, by their whole sets."""
    pairs = materialised(pairs.distinct())
    few = _few(pairs)
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    sets = docs.join(_light(ids, few), "doc_id", "left_semi").distinct().select("doc_id", _shingles("t").alias("s"))
    sets = materialised(sets)
    both = _light(pairs, few).join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b").hint("merge"), "v")
    common = F.size(F.array_intersect("a", "b"))
    return materialised(both.where(common * 9 >= (F.size("a") + F.size("b")) * 4).select("u", "v").distinct())


def simhash_candidates(nodes: DataFrame) -> DataFrame:
    """(u, v): each of nodes(rep, sim) with the smallest that has its fingerprint, and that one with its smallest neighbour within 3 bits."""
    prints = materialised(nodes.groupBy(F.col("sim").alias("fp")).agg(F.min("rep").alias("rep")))
    equal = nodes.join(prints.toDF("sim", "v").hint("merge"), "sim").select(F.col("rep").alias("u"), "v").where("u <> v")
    return equal.unionAll(simhash.links(prints).groupBy("u").agg(F.min("v").alias("v")))


def _joined(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(u, c): each of nodes(rep) with a text that it is joined to over linked, the same for all that are joined."""
    parts = connected_components(linked)
    return materialised(nodes.join(parts.hint("merge"), nodes.rep == parts.node, "left").select(F.col("rep").alias("u"), F.coalesce("component", "rep").alias("c")).distinct())


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v) that connect all nodes(rep, sim, n, odd, prefix) whose sets are similar enough; docs has doc_id, t."""
    table = nodes.select(F.col("rep").alias("u"), "n", F.posexplode("prefix").alias("p", "s"))
    shared = materialised(table.groupBy("s").agg(F.count("*").alias("k"), F.min("u").alias("first")).where("k > 1").select("s", "first"))
    table = materialised(table.hint("merge").join(shared, "s"))
    apart = sum((F.bit_count(F.col("odd_u")[i].bitwiseXOR(F.col("odd_v")[i])) for i in range(BUCKETS // 64)), F.lit(0))

    def alike(pairs: DataFrame) -> DataFrame:
        """Of pairs(u, v) those that sizes and bitmaps allow; a doc_id with several texts has several, of which one suffices."""
        left, right = (nodes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")) for c in "uv")
        near = (F.col("n_u") * 5 >= F.col("n_v") * 4) & (F.col("n_v") * 5 >= F.col("n_u") * 4) & (apart * 9 <= F.col("n_u") + F.col("n_v"))
        pairs = materialised(pairs.distinct())
        few = _few(pairs)
        return _light(_light(pairs, few).join(left, "u"), few).join(right, "v").where(near).select("u", "v")

    copies = _similar(alike(simhash_candidates(nodes)), docs)
    centre = _joined(nodes, copies)
    pairs = table.where("u <> first").select("u", F.col("first").alias("v")).distinct()
    pairs = pairs.join(centre.hint("merge"), "u").join(centre.toDF("v", "d").hint("merge"), "v").where("c <> d").select("u", "v")
    stars = copies.unionAll(_similar(alike(pairs), docs))
    table = table.join(_joined(nodes, stars).hint("merge"), "u").select("s", "u", "n", "p", "c")
    open_ = materialised(table.groupBy("s").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("s"))
    table = table.join(_light(open_, _few(open_)), "s", "left_semi")
    other = table.toDF("s", "v", "m", "q", "d")
    # What is left of both from their first common shingle on bounds the overlap, which must be 4/9 of the sum of sizes.
    room = F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) * 9 >= (F.col("n") + F.col("m")) * 4
    near = (F.col("n") * 5 >= F.col("m") * 4) & (F.col("m") * 5 >= F.col("n") * 4)
    rest = table.join(other.hint("merge"), "s").where((F.col("u") > F.col("v")) & (F.col("c") != F.col("d")) & room & near)
    return stars.unionAll(_similar(alike(rest.select("u", "v")), docs))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float | None = MISS) -> DataFrame:
    """(doc_id, component_id) of every row of docs; component_id is the smallest doc_id reachable over links.

    With miss=None prefixes are whole: no link is lost, at a fifth of all shingles in the candidate search.
    """
    texts = in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    prints = materialised(_prints(texts, _popular(texts), miss))
    same = [F.first(c).alias(c) for c in ("sim", "n", "odd", "prefix")]
    nodes = materialised(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), *same))
    return components_of(prints.select("doc_id", "fp"), nodes.select("fp", "rep"), links(nodes, texts)).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """docs with one row of each component: the row of its smallest id, once; rows with a null id stay."""
    return keep_smallest(docs, near_copies(docs, id_col, text_col), id_col, max_broadcast_rows)
