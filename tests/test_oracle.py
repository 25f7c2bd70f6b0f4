"""Every registered query against its SQL twin at the smallest scale."""

import pytest
from check import compare, connect

from __spark_entry__ import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    message, ok = compare(spark, con, SF_DIR, name, queries()[name], oracle_sql().get(name))
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
