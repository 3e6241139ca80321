"""Queries with SQL give its rows on the smallest tables."""

import pytest

from spindrel.llm.queries import QUERIES, SQL
from spindrel.plans.compare import differences, duck


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_of_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), duck(sf), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_session_stays_as_it_was(spark, sf, name):
    before = dict(spark.conf.getAll)
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
    changed = {k for k, v in dict(spark.conf.getAll).items() if before.get(k) != v}
    assert changed <= {"spark.spindrel.scratch"}
