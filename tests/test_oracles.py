"""Every core query with SQL gives the same rows; the others run."""

import pytest
from compare import differences

from vellumq.plans import nested, oracles, queries

ALL = {**queries.queries(), **nested.queries()}
SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    assert differences(spark, data, ALL[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, data, name):
    assert ALL[name](spark, data).count() >= 0
