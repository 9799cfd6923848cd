"""Every query with SQL is compared with that SQL, row by row, on the smallest tables; the others must run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidalgrid import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame, names):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 3) if isinstance(v, float) else v

    return sorted((tuple(plain(r[n]) for n in names) for r in frame), key=repr)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_matches_sql(spark, oracle, name):
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    relation = oracle.sql(entry.oracle_sql()[name])
    want = [dict(zip(relation.columns, r)) for r in relation.fetchall()]
    assert sorted(relation.columns) == names
    assert rows([r.asDict() for r in got.collect()], names) == rows(want, names)


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["deepest_lookup", "navmap_decide", "legal_points", "map_leaves", "map_settled", "pyramid"])
def test_map_matches_sql_below_zero_and_without_balances(spark, tmp_path, name):
    """Keys below zero, several customers a cell, customers and whole cells without a balance, and orders listed twice."""
    c = duckdb.connect()
    c.execute(f"copy (select c_custkey - 70 * (n + 1) as c_custkey, if((c_custkey - 70 * n) % 5 = 0, null, c_acctbal) as c_acctbal from '/root/testdata/sf0.01/customer.parquet', range(3) r(n)) to '{tmp_path}/customer.parquet'")
    c.execute(f"copy (select o_orderkey - 700 as o_orderkey from '{SF}/orders.parquet', range({2 if name == 'deepest_lookup' else 1})) to '{tmp_path}/orders.parquet'")
    for t in ("customer", "orders"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    names = sorted(got.columns)
    want = c.execute(f"select {', '.join(names)} from ({entry.oracle_sql()[name]}) q").fetchall()
    found = rows([r.asDict() for r in got.collect()], names)
    assert found and found == rows([dict(zip(names, r)) for r in want], names)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "value"]
