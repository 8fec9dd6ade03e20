"""Toxicity: a character n-gram linear classifier with naive Bayes log-count ratio features.

A text's features are the distinct character n-grams of its lower-cased words, each word between two spaces, hashed to
``BUCKETS`` ids: those of ``ORDERS`` code points anywhere, and longer ones that begin with the space before a word (``INITIAL``),
since the start of a word tells more than its inside. Feature f has the value r[f], the smoothed log ratio of its share of the
toxic and of the other training texts; logistic regression on these values gives the weights, so a score is
sigmoid(bias + sum of w[f] * r[f]). Features whose counts don't depend on the label (a log-likelihood ratio statistic under
``MIN_EVIDENCE``) get no weight: there are thousands a text, and rare ones would fit the sample by chance.

It is fitted on at most ``max_rows`` labelled rows, half of them toxic where there are enough: those with the smallest
hash of their id. That bound covers what is fitted only; scoring covers whole texts of all rows without a shuffle. Counts
are taken on the cluster, and only the counts of the ``BUCKETS`` features and the rows' features with evidence come to the
driver. The bias is corrected for the share of toxic rows among all labelled rows.

Defined cases: null and wordless texts have no features and score at the bias; rows with a null label, or a null id in
either table, are not learnt from; of several texts with one id the least is learnt from; without rows of both classes every
score is the smoothed share of toxic labels; repeated rows get equal scores; a very long text takes memory in proportion to
its distinct words; an empty table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.llm.storage import in_small_batches, materialised

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Code points of n-grams anywhere, and of those with the space in front of a word.
ORDERS, INITIAL = (3, 4, 5, 6), (5, 6, 7, 8, 9)
MAX_ROWS, THRESHOLD, HELD_OUT_FOLD, FOLDS = 4000, 0.7, 1, 3
L2, ROUNDS, SMOOTHING, MIN_TEXTS, MIN_EVIDENCE = 0.02, 120, 1.0, 3, 20.0
#: Training rows whose terms are formed at a time; bounds memory.
ROWS_PER_BLOCK = 256
#: Odd multipliers with well-mixed bits.
MULTIPLIER, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def feature_rows(text: str | None) -> np.ndarray:
    """Feature ids of a text's distinct words, with repeats."""
    words = set((text or "").lower().split())
    if not words:
        return np.empty(0, np.int32)
    line = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space, found = line == 32, []

    def longer(key: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = key * MULTIPLIER + code
        return key ^ (key >> np.uint64(29))

    def hashed(key: np.ndarray) -> np.ndarray:
        return (key * MIXER) >> np.uint64(64 - BUCKET_BITS)

    # open: n-grams without a space inside
    key, open_ = line, np.ones(len(line), bool)
    for n in range(2, min(max(ORDERS), len(line)) + 1):
        key = longer(key[:-1], line[n - 1 :])
        open_ = open_[:-1] & ~space[n - 2 : -1] if n > 2 else open_[:-1]
        if n in ORDERS:
            found.append(hashed(key[open_]))
        elif n in INITIAL:
            found.append(hashed(key[open_ & space[: len(key)]]))
    at = np.flatnonzero(open_ & space[: len(open_)])
    key = key[at]
    for n in range(max(ORDERS) + 1, max(INITIAL) + 1):
        going = (at + n <= len(line)) & ~space[np.minimum(at + n - 2, len(line) - 1)]
        at = at[going]
        key = longer(key[going], line[at + n - 1])
        if n in INITIAL:
            found.append(hashed(key))
    return np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)


def features(text: str | None) -> np.ndarray:
    """Distinct feature ids of a text, in ascending order."""
    return np.unique(feature_rows(text))


@dataclass
class Model:
    """weights[f] is w[f] * r[f]."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        ids = feature_rows(text)
        z = self.bias + float(self.weights[np.unique(ids[self.weights[ids] != 0])].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def ratios(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Smoothed log-count ratios of the features by counts[label, feature] over rows[label] texts; 0 for those without evidence."""
    p, q = counts[1] + SMOOTHING, counts[0] + SMOOTHING
    both = counts.sum(axis=0)
    expected = both * (rows / rows.sum())[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * np.where(counts > 0, counts * np.log(counts / expected), 0).sum(axis=0)
    return np.where((both >= MIN_TEXTS) & (evidence >= MIN_EVIDENCE), np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def constant(toxic_share: float) -> Model:
    """The model without features."""
    share = min(max(toxic_share, 1e-3), 1 - 1e-3)
    return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))


def fit(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, toxic_share: float) -> Model:
    """Logistic regression on the rows' distinct features scaled by their ratios; toxic_share corrects the bias."""
    label = np.asarray(label, np.int64)
    if not 0 < label.sum() < len(label):
        return constant(toxic_share)
    used = np.flatnonzero(ratio)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    value = ratio[used]
    blocks = []
    for at in range(0, len(rows), ROWS_PER_BLOCK):
        part = [place[x] for x in rows[at : at + ROWS_PER_BLOCK]]
        part = [x[x >= 0] for x in part]
        of_row = np.repeat(np.arange(len(part), dtype=np.int32), [len(x) for x in part])
        blocks.append((np.concatenate(part), of_row, slice(at, at + len(part))))
    # Nesterov's method on the scaled problem; one step size per feature from its curvature bound
    n, curve = len(label), np.zeros(len(used))
    for ids, of_row, block in blocks:
        size = np.bincount(of_row, weights=np.abs(value)[ids], minlength=block.stop - block.start)
        curve += 0.25 * np.bincount(ids, weights=size[of_row], minlength=len(used)) * np.abs(value)
    curve += L2
    w, bias = np.zeros(len(used)), 0.0
    ahead, bias_ahead = w, bias
    for k in range(ROUNDS):
        grad, bias_grad, scaled = L2 * ahead, 0.0, ahead * value
        for ids, of_row, block in blocks:
            z = np.bincount(of_row, weights=scaled[ids], minlength=block.stop - block.start) + bias_ahead
            residual = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label[block]
            grad += np.bincount(ids, weights=residual[of_row], minlength=len(used)) * value
            bias_grad += residual.sum()
        last, bias_last = w, bias
        w, bias = ahead - grad / curve, bias_ahead - bias_grad / n
        ahead, bias_ahead = w + k / (k + 3) * (w - last), bias + k / (k + 3) * (bias - bias_last)
    weights = np.zeros(BUCKETS)
    weights[used] = w * value
    had = label.mean()
    prior = min(max(toxic_share, 1e-6), 1 - 1e-6)
    return Model(weights, float(bias + np.log(prior / (1 - prior)) - np.log(had / (1 - had))))


def held_out(id_col: Column) -> Column:
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _features(text: pa.Array) -> pa.Array:
    return pa.array([features(x) for x in text.to_pylist()], pa.list_(pa.int32()))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS
) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).alias("__pg_id"), (F.col(label_col) == 1).cast("int").alias("__pg_y")).distinct()
    counts = dict(known.groupBy("__pg_y").count().collect())
    total = sum(counts.values())
    by_hash = [F.xxhash64("__pg_id"), F.col("__pg_id"), F.col("__pg_y")]
    half = max_rows // 2
    toxic = min(counts.get(1, 0), max(half, max_rows - counts.get(0, 0)))
    chosen = known.where("__pg_y = 1").orderBy(*by_hash).limit(toxic).unionAll(known.where("__pg_y = 0").orderBy(*by_hash).limit(max_rows - toxic))
    texts = in_small_batches(docs).select(F.col(id_col).alias("__pg_id"), F.col(text_col).cast("string").alias("__pg_text"))
    # chosen holds at most max_rows rows of 12 bytes
    sample = texts.join(F.broadcast(chosen), "__pg_id").groupBy("__pg_id", "__pg_y").agg(F.min("__pg_text").alias("__pg_text"))
    sample = materialised(sample.select("__pg_id", "__pg_y", _features("__pg_text").alias("__pg_f")))
    share = counts.get(1, 0) / total if total else 0.0
    rows = dict(sample.groupBy("__pg_y").count().collect())
    if not (rows.get(0) and rows.get(1)):
        return constant(share)
    found = sample.select("__pg_y", F.explode("__pg_f").alias("f")).groupBy("f").agg(F.sum("__pg_y").alias("toxic"), F.count("*").alias("n")).toArrow()  # at most BUCKETS rows
    table, f = np.zeros((2, BUCKETS)), found["f"].to_numpy()
    table[1, f] = found["toxic"].to_numpy()
    table[0, f] = found["n"].to_numpy() - found["toxic"].to_numpy()
    ratio = ratios(table, np.array([rows[0], rows[1]]))
    shared = docs.sparkSession.sparkContext.broadcast(np.flatnonzero(ratio).astype(np.int32))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def with_evidence(ids: pa.Array) -> pa.Array:
        return pa.array([np.intersect1d(np.asarray(x, np.int32), shared.value, assume_unique=True) for x in ids.to_pylist()], pa.list_(pa.int32()))

    # at most max_rows rows
    least = sample.select("__pg_id", "__pg_y", with_evidence("__pg_f").alias("f")).toArrow().to_pylist()
    least.sort(key=lambda r: (r["__pg_id"], r["__pg_y"]))
    return fit([np.array(r["f"], np.int32) for r in least], [r["__pg_y"] for r in least], ratio, share)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # BUCKETS doubles: 8 MB

    @F.arrow_udf(T.DoubleType())
    def scored(text: pa.Array) -> pa.Array:
        model = Model(*shared.value)
        return pa.array([model.score(x) for x in text.to_pylist()], pa.float64())

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    out = in_small_batches(docs).select(*kept, scored(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
