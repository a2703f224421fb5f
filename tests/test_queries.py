"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(v):
        return "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon(df.collect(), df.columns) == canon(want.fetchall(), cols)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_query_hits_prefer_full_matches(spark):
    hits = entry.queries()["seed_query_hits"](spark, SF).collect()
    assert 0 < len(hits) <= 8 and all(0.6 <= r.q <= 1.0 for r in hits)


def test_agent_window_covers_every_node(spark):
    window = entry.queries()["attend_agent_window"](spark, SF)
    plain = entry.queries()["attend_nodes"](spark, SF)
    assert window.count() == plain.count()


def test_content_digest_is_stable_and_sensitive(spark):
    from mnemograph.operators.log_ops import content_digest
    from mnemograph.plans.queries import log_of
    log = log_of(spark, SF)
    one = content_digest(log).collect()[0].digest
    assert one == content_digest(log.repartition(5)).collect()[0].digest
    assert one != content_digest(log.filter("seq <> 17")).collect()[0].digest
