"""Every registered query against its SQL twin."""

import os

import pytest
from compare import difference, twin_connection

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def twin():
    return twin_connection(SF_DIR)


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, twin, name):
    assert difference(queries()[name](spark, SF_DIR), twin, oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_twin(spark, name):
    assert queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 15
