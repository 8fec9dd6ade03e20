from collections import namedtuple

from pyspark.sql import functions as F

from pitchgrid.models import labelling

Fitted = namedtuple("Fitted", "node size")


def test_a_stage_grows_until_nothing_more_is_taken(spark, monkeypatch):
    """Node 0 reaches one row further with each row it has, so that each round takes in one row."""

    def fit(members, hist, components):
        row = members.agg(F.first("node"), F.count("*")).first()
        return Fitted(*row)

    def distance(m, criterion):
        return F.when(F.col("hist")[0] <= m.size, 0.0).otherwise(1.0) if m.node == 0 else F.lit(1.0)

    monkeypatch.setattr(labelling, "fit_mixture", fit)
    monkeypatch.setattr(labelling, "log_likelihood", lambda m, hist: F.lit(1.0))
    monkeypatch.setattr(labelling, "mixture_distance", distance)
    pool = spark.createDataFrame([(i, [float(i)]) for i in range(26)], "id long, hist array<double>")
    seeds = [pool.where(F.col("id") == 0), *[spark.createDataFrame([(i, [99.0])], pool.schema) for i in (101, 102)]]
    grown = labelling.grow(pool, seeds, thresholds=[(0.15, 0.25)])
    assert sorted(r.id for r in grown.where("node = 0").collect()) == list(range(26))
