"""Every core query with SQL gives what DuckDB gives; the others run and give rows."""

import os

import pytest
from oracle import DATA, compare, connect

from tropelake.plans import core

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_sql(spark, con, name):
    compare(spark, con, core.queries()[name], core.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    assert core.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert core.entry(spark, DATA).count() > 0
