"""Registered queries against their SQL on the smallest tables."""

import math
import os
from datetime import date, datetime

import pytest

from airloft.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") + 0.0
    return str(v) if isinstance(v, (date, datetime)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = db.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4


def test_deploy_gate_searches_all_strategies(spark, monkeypatch):
    from airloft.operators import interpolate
    from airloft.plans import analytic_queries

    searched, search = [], interpolate.search_corrections

    def recorded(*args, **kwargs):
        searched.append(search(*args, **kwargs))
        return searched[0]

    monkeypatch.setattr(analytic_queries.itp, "search_corrections", recorded)
    assert analytic_queries.deploy_gate(spark, SF).count() == 1
    names = {r["name"] for r in searched[0].select("name").collect()}
    assert names == {f"{c['kind']}-{i}" for i, c in enumerate(interpolate.STRATEGIES)}
