"""Every registered query against its SQL, on the smallest tables."""

import pytest
from micro_ledger import SMALL

import __spark_entry__ as entry
import check_queries
import oracle_queries


@pytest.fixture(scope="module")
def db():
    return check_queries.duck(SMALL)


def test_every_query_has_sql():
    assert set(entry.ledger_queries()) == set(oracle_queries.oracle_sql())
    assert set(entry.ledger_queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["sid", "date", "description"]


@pytest.mark.parametrize("name", list(entry.ledger_queries()))
def test_query(spark, db, name):
    note, same = check_queries.compare(spark, db, SMALL, name, entry.ledger_queries()[name], oracle_queries.oracle_sql()[name])
    assert same, note
