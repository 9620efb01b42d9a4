"""Queries with SQL give the same rows; the others run over the smallest tables."""

import pytest
from compare import differences

from vellumq.llm import queries as q

ALL, SQL = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    assert differences(spark, data, ALL[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, data, name):
    df = ALL[name](spark, data)
    assert df.count() >= 0
    want = {"p2_found": ["rec_kind", "rec_id"], "p6_found": ["block_id", "defect"], "p7_found": ["block_id", "line_no"], "p8_found": ["doc_id"], "p10_found": ["doc_id", "lang"]}
    if name in want:
        assert df.columns == want[name]
        assert df.count() == df.distinct().count()
