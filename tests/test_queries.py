import pytest
from sqlcheck import against_sql

from weirflow.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    mine, theirs = against_sql(spark, name)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
