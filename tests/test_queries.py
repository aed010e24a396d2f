"""Every registered query gives the rows of its SQL twin."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences
from tests.conftest import SMALL
from workloads import registry

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_entry_registers_all():
    assert QUERIES.items() <= entry.queries().items()
    assert ORACLES.items() <= entry.oracle_sql().items()


def test_every_twin_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert differences(spark, con, SMALL, QUERIES[name], ORACLES[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 4
