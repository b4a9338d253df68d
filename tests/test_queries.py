"""Every query with an oracle gives the oracle's rows; the others give rows."""

import pytest
from compare import differences

from kadastra.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert not differences(df, ORACLES[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
