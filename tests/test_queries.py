"""Every query of the core against its SQL on the smallest tables; those without SQL must give rows."""

import importlib

import pytest

from oracle import ROOT, bag, connect

MODULES = ("keys", "store", "scalars", "vectors", "audit", "passages", "coverage", "search", "jobs")
CASES = {k: (f, m.SQL.get(k)) for name in MODULES for m in [importlib.import_module(f"quirework.plans.{name}")] for k, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return connect("sf0.001")


@pytest.mark.parametrize("name", sorted(CASES))
def test_against_sql(spark, con, name):
    query, sql = CASES[name]
    got = query(spark, f"{ROOT}/sf0.001").toPandas()
    if sql is None:
        assert len(got)
    else:
        assert bag(got) == bag(con.execute(sql).df())
