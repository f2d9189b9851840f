"""Every catalogue query against its SQL on the smallest tables."""

import pytest

from locusflow.plans.catalog import ORACLES, QUERIES
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, compare):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        compare(df, duck.sql(ORACLES[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
