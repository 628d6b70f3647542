"""Streams against their SQL on the smallest tables, and files that arrive late."""

import pytest

from oracle import ROOT, bag, connect
from quirework.streaming import jobs


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_against_sql(spark, name):
    assert bag(jobs.QUERIES[name](spark, f"{ROOT}/sf0.001").toPandas()) == bag(connect("sf0.001").execute(jobs.SQL[name]).df())
