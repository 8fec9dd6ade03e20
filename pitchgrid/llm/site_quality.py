"""Quality classifier by hierarchical empirical Bayes over documents, paths and hosts.

A document's own evidence p comes from logistic regressions on surface measures of its whole text, fitted on labelled rows.
There are two models. Ids fall into two folds by a hash, and each row is scored by the model that learnt from the other
fold, so no row's evidence comes from its own label.
Sums of p by path and host give the posteriors of sites: a host's mean is shrunk toward the global mean and a path's
toward its host's, as (sum + k * mean above) / (n + k). The strengths k are estimated from the table: the moments of the
group means against their sampling variance (more spread between groups, less shrinkage), so a sparse site stays near the
level above. A document's own evidence is left out of its site's sums. The score is
sigmoid(logit(p) + logit(path posterior) - logit(global mean)).

Sums combine in the map tasks, so a host with a third of all rows is no bottleneck; the table of sites is broadcast only if
counted to be small, and joined by a shuffle that Spark can split otherwise. Nine numbers a model and two strengths
reach the driver. Texts are never shuffled.

Defined cases: null texts count as empty, very long ones are measured whole; a null host or path is a site of its own; rows
with a null id or label are not learnt from; an id labelled twice counts as two rows; where a fold's model finds no rows of
both labels, its rows' evidence is the smoothed share of good labels (0.5 without any); equal scores are judged alike, a
score of just the threshold is kept; repeated rows count as often as they occur; an empty table gives an empty result;
columns named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.storage import discard, materialised

FEATURES = ("log_words", "symbols", "digits", "capitals", "word_length", "distinct_words", "line_length", "repeated_lines")
RESULTS = ("doc_score", "host_posterior", "path_posterior", "score", "kept")
THRESHOLD, MAX_BROADCAST_ROWS = 0.5, 1_000_000
MIN_STRENGTH, MAX_STRENGTH, EDGE, FOLDS = 1.0, 1e4, 1e-4, 2


def measures(text: Column) -> list[Column]:
    """Surface measures of a whole text, named as in FEATURES."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    share = lambda pattern: F.length(F.regexp_replace(text, f"[^{pattern}]+", "")) / F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    count = F.greatest(F.size("__pg_w"), F.lit(1))
    return [
        words.alias("__pg_w"), lines.alias("__pg_l"), F.length(text).alias("__pg_n"),
        share("#*$%&|<>").alias("symbols"), share("0-9").alias("digits"), share("A-Z").alias("capitals"),
        F.log1p(F.size("__pg_w")).alias("log_words"), (F.col("__pg_n") / count).alias("word_length"),
        (F.size(F.array_distinct("__pg_w")) / count).alias("distinct_words"),
        (F.col("__pg_n") / F.greatest(F.size("__pg_l"), F.lit(1))).alias("line_length"),
        (1 - F.size(F.array_distinct("__pg_l")) / F.greatest(F.size("__pg_l"), F.lit(1))).alias("repeated_lines"),
    ]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def fold(id_: Column) -> Column:
    """The fold of an id."""
    return F.coalesce(F.pmod(F.xxhash64(id_.cast("string")), F.lit(FOLDS)), F.lit(0))


def _model(rows: DataFrame) -> Column:
    """Evidence as an expression over the measures, fitted on rows(*FEATURES, __pg_y)."""
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("__pg_y"), F.lit(0.0))).first()
    if not 0 < good < n:
        return F.lit((good + 1) / (n + 2))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__pg_x").transform(rows)
    model = LogisticRegression(featuresCol="__pg_x", labelCol="__pg_y", maxIter=50, regParam=1e-4).fit(vectors)
    z = F.lit(float(model.intercept))
    for name, weight in zip(FEATURES, model.coefficients.toArray().tolist(), strict=True):
        z = z + F.col(name) * F.lit(weight)
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def _evidence(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Column:
    """Each row's own evidence, by the model of the other fold."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.select(F.col(id_col).alias("__pg_id"), (F.col(label_col) == 1).cast("double").alias("__pg_y")).distinct()
    rows = materialised(measured.select("__pg_id", *FEATURES).join(known, "__pg_id"))
    of, out = fold(F.col("__pg_id")), F.lit(None).cast("double")
    for k in range(FOLDS):
        out = F.when(of == k, _model(rows.where(of != k))).otherwise(out)
    discard(rows)
    return out


def _strength(groups: DataFrame, mean: Column) -> float:
    """How many documents the level above is worth: method of moments on groups (n, s) around mean."""
    m = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"), F.sum("q").alias("within"),
        F.sum("n").alias("n"), F.count("*").alias("groups"),
    ).first()
    if not m["n"] or m["groups"] < 2:
        return MAX_STRENGTH
    variance = m["within"] / m["n"]  # of one document within its group
    spread = max(m["between"] - m["groups"] * variance, 0.0) / m["n"]
    return min(max(variance / spread, MIN_STRENGTH), MAX_STRENGTH) if spread > 0 else MAX_STRENGTH


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By group: n, the sum s of p, and q, the sum of squares around the group's own mean."""
    got = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    return got.withColumn("q", F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))).drop("ss")


def site_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """docs without text_col, with doc_score, host_posterior, path_posterior, score and kept; path is taken within its host."""
    passed = [c for c in docs.columns if c not in (*RESULTS, text_col)]
    first, second = measures(F.col(text_col))[:6], measures(F.col(text_col))[6:]
    site = [host.cast("string").alias("__pg_host"), path.cast("string").alias("__pg_path"), F.col(id_col).alias("__pg_id")]
    rename = {c: f"__pg_in_{i}" for i, c in enumerate(passed)}  # so that input columns can't clash with the measures
    base = docs.select(*[F.col(c).alias(a) for c, a in rename.items()], *site, *first)
    measured = materialised(base.select("*", *second).drop("__pg_w", "__pg_l", "__pg_n"))
    rows = materialised(measured.withColumn("p", _evidence(measured, labels, id_col, label_col)).drop(*FEATURES))
    paths = materialised(_sums(rows, ["__pg_host", "__pg_path"]))
    hosts = materialised(_sums(rows, ["__pg_host"]))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = (s + 0.5) / (n + 1) if n else 0.5
    k_host = _strength(hosts, F.lit(mean))
    up = hosts.select(F.col("__pg_host").alias("__pg_h"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    sites = paths.join(up, F.col("__pg_host").eqNullSafe(F.col("__pg_h"))).withColumn("hm", F.col("hs") / F.col("hn"))
    k_path = _strength(sites, F.col("hm"))
    sites = sites.select("__pg_h", F.col("__pg_path").alias("__pg_q"), "n", "s", "hn", "hs")
    if sites.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        sites = F.broadcast(sites)
    same = F.col("__pg_host").eqNullSafe(F.col("__pg_h")) & F.col("__pg_path").eqNullSafe(F.col("__pg_q"))
    joined = rows.join(sites, same)
    p = F.col("p")
    of_host = (F.col("hs") - p + k_host * mean) / (F.col("hn") - 1 + k_host)
    of_path = (F.col("s") - p + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    z = _logit(p) + _logit(F.col("path_posterior")) - F.lit(math.log(min(max(mean, EDGE), 1 - EDGE) / (1 - min(max(mean, EDGE), 1 - EDGE))))
    out = joined.withColumn("host_posterior", of_host).withColumn("path_posterior", of_path).withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select(
        *[F.col(a).alias(c) for c, a in rename.items()], p.alias("doc_score"), "host_posterior", "path_posterior", "score",
        (F.col("score") >= threshold).alias("kept"),
    )
