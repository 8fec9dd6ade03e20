"""Every query of the video-analytics part against its SQL."""

import glob
import os

import duckdb
import pytest

from pitchgrid.plans import file_queries, picture_queries, queries  # noqa: F401
from pitchgrid.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(repr(r[i]) for i in order) for r in data])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    sql = duck.execute(ORACLES[name])
    columns = [c[0] for c in sql.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(sql.fetchall(), columns)


@pytest.mark.parametrize("name", ["kmeans_assign", "gmm_size_filter", "team_classifier", "epoch_training"])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
