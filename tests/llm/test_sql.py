"""Queries of the training-data operators against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from mnemograph.llm import queries
from tests.test_queries import canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon(df.collect(), df.columns) == canon(want.fetchall(), cols)
