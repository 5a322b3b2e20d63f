"""Every query that has SQL must equal it on the smallest tables."""

import pytest
from oracle import ROOT, difference

import __spark_entry__ as entry

SMALL = f"{ROOT}/sf0.001"
SQL = entry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 2


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(entry.queries()[name](spark, SMALL), SQL[name], SMALL) is None
