"""Every registered query against its SQL on the smallest test tables."""

import pytest

import __spark_entry__ as contract
from orbitlake.workload import oracle
from orbitlake.workload import queries as work
from tools.check import compare, database

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(work.queries()))
def test_query_agrees_with_sql(spark, db, name):
    assert compare(spark, db, FOLDER, name).startswith("OK")


def test_every_query_has_sql():
    assert set(work.queries()) == set(oracle.oracle_sql())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
