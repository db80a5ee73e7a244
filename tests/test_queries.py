"""Every registered query of the session engine runs, and equals its SQL where it has one."""

import pytest

from oracle import compare, connect
from veldspar import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        compare(con, df, catalog.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
