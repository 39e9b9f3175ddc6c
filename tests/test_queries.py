"""Every registered query against its SQL twin at the smallest scale, and the driver contract."""

import pytest

import __spark_entry__ as entry
from tests.conftest import FOLDER
from tools.check_oracle import compare, views

QUERIES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    verdict, _, rows = compare(spark, con, FOLDER, name)
    assert verdict in ("ok", "rows only"), verdict
    assert rows >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity", "rev_id", "valid_from", "valid_to", "segment", "nation"] and df.count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
