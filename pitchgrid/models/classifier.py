"""Team classifiers that Spark can train: multinomial regression, and an approximate RBF kernel machine.

They stand in for an image network and a kernel SVM; both keep the interface of keys in, class scores out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Classifier:
    """A fitted regression and the feature map in front of it."""

    model: LogisticRegressionModel
    features: object = None


def fit(rows: DataFrame, column: str, label: str, features=None, max_iter: int = 100, reg: float = 1e-4) -> Classifier:
    """Multinomial logistic regression on an array column, through features if given."""
    x = features(F.col(column)) if features else F.col(column)
    v = rows.select(array_to_vector(x.cast("array<double>")).alias("__v"), F.col(label).cast("double").alias("__y"))
    model = LogisticRegression(featuresCol="__v", labelCol="__y", family="multinomial", maxIter=max_iter, regParam=reg).fit(v)
    return Classifier(model, features)


def fit_best(train: DataFrame, valid: DataFrame, column: str, label: str, regs: tuple[float, ...] = (1e-4, 1e-3, 1e-2), features=None, path: str | None = None):
    """(classifier, metrics): the strength of regularisation with the least validation loss; the best model is saved to path.

    metrics has one row per strength: reg, loss (mean cross-entropy weighted by actual counts) and accuracy on valid.
    """
    best, rows = None, []
    for reg in regs:
        model = fit(train, column, label, features, reg=reg)
        scored = classify(model, valid, column)
        own = F.get("probabilities", F.col(label).cast("int"))
        guess = F.array_position("probabilities", F.array_max("probabilities")) - 1
        loss, accuracy = scored.agg(F.avg(-F.log(F.greatest(own, F.lit(1e-12)))), F.avg((guess == F.col(label)).cast("double"))).first()
        rows.append((reg, loss, accuracy))
        if best is None or (loss is not None and loss < best[0]):
            best = (loss, model)
            if path:
                model.model.write().overwrite().save(path)
    return best[1], train.sparkSession.createDataFrame(rows, "reg double, loss double, accuracy double")


def classify(classifier: Classifier, rows: DataFrame, column: str) -> DataFrame:
    """rows with logits (raw scores) and probabilities per class."""
    x = classifier.features(F.col(column)) if classifier.features else F.col(column)
    model = classifier.model.setFeaturesCol("__v").setRawPredictionCol("__raw").setProbabilityCol("__p").setPredictionCol("__c")
    out = model.transform(rows.withColumn("__v", array_to_vector(x.cast("array<double>"))))
    return out.withColumn("logits", vector_to_array("__raw")).withColumn("probabilities", vector_to_array("__p")).drop("__v", "__raw", "__p", "__c")


def fourier_features(dimension: int, gamma: float = 0.1, size: int = 128, seed: int = 42):
    """A map of arrays to random Fourier features whose products approximate the kernel exp(-gamma * squared distance)."""
    rng = np.random.default_rng(seed)
    direction, phase = rng.normal(0, np.sqrt(2 * gamma), (dimension, size)), rng.uniform(0, 2 * np.pi, size)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def mapped(values: pa.Array) -> pa.Array:
        x = np.asarray(values.to_pylist(), float).reshape(-1, dimension)
        return pa.array(list(np.sqrt(2 / size) * np.cos(x @ direction + phase)), pa.list_(pa.float64()))

    return lambda c: mapped(c.cast("array<double>"))


