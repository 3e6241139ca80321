"""Every core query with SQL gives the rows of its SQL on the smallest tables; every other one runs."""

import pytest

from spindrel.plans.catalog import QUERIES, SQL
from spindrel.plans.compare import differences, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_of_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
