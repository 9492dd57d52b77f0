"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, difference

from redpen.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CATALOG)
def test_query(spark, con, name):
    query, sql = CATALOG[name]
    df = query(spark, SF)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
