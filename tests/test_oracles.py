"""Every registered query against its SQL twin, value by value."""

import pytest

from checks.compare import compare, connect
from checks.oracles import ORACLES
from checks.queries import QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    assert compare(spark, duck, SMALL, name) is None


def test_entry(spark):
    import __spark_entry__ as entry

    first = entry.entry(spark)
    assert first.count() == 150
    assert first.schema == entry.entry(spark).schema
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["l01_newest_sites", "l02_crews_by_name", "l03_newest_ids", "l04_by_due_date", "l05_by_priority_rank"])
def test_order_of_lists(spark, duck, name):
    """Sorted lists, row by row."""
    wanted = duck.sql(ORACLES[name])
    found = QUERIES[name](spark, SMALL).select(*wanted.columns).collect()
    assert [r[0] for r in found] == [r[0] for r in wanted.fetchall()]
