"""Registered queries next to their SQL twins at the smallest scale: all of them, but those of the optional
corpus operators, which have tests of their own."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
NAMES = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, QUERIES[name], ORACLE.get(name))
    assert ok, message


def test_twins_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
