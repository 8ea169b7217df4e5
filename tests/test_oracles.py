"""Every query of the library against its SQL, row by row, and those without SQL for their shape."""

import pytest

from sightline import plans

from .conftest import SF

QUERIES, SQL = plans.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, same):
    same(name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
