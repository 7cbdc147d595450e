"""Every query of the core against its SQL over whole small tables."""

import pytest
from oracle import compare

from facetry.plans import core


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, sf, name):
    query, sql = core.queries()[name], core.oracle_sql().get(name)
    if sql:
        compare(spark, sf, query, sql)
    else:
        assert query(spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
