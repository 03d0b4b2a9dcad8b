"""Every registered query of the record operators against its SQL."""

import pytest
from compare import connection, rows_of, rows_of_sql

from provenant.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    columns, rows = rows_of(registry.queries()[name](spark, DATA))
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
    else:
        assert (columns, rows) == rows_of_sql(con, sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
