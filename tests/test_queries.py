"""Every query of the library against its SQL on the smallest tables."""

import pytest
from helpers import SMALL, rows

from veritrail.plans import registry

COMPARED = sorted(registry.SQL)


@pytest.mark.parametrize("name", COMPARED)
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
