"""Every registered query against its SQL, on the smallest of the given data sets."""

import os

import pytest

import __spark_entry__ as contract
from check import compare, oracle_connection
from workload import registry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")

QUERIES = {name: q for name, q in contract.queries().items() if name in registry.QUERIES}
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    good, note = compare(spark, oracle, SF_DIR, name, QUERIES[name], SQL.get(name))
    assert good, note


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(SQL)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
