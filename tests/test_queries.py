"""Every query against its SQL on the smallest tables."""

import pytest

from noticeworks import plans
from tests.compare import DATA, database, rows


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert name in plans.ORACLES
    found = plans.QUERIES[name](spark, DATA).toPandas()
    wanted = con.execute(plans.ORACLES[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry_point_lists_every_query(spark):
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0
