"""Every query of the catalogue against its SQL."""

import pytest
from oracle import assert_same

from walkframe.plans import catalog


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    assert assert_same(catalog.QUERIES[name](spark, data), catalog.ORACLE_SQL[name], data) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
