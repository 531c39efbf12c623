"""Every registered query that has SQL against that SQL; the others must give rows."""

import duckdb
import pytest
from llm_inputs import SMALL

import __spark_entry__ as entry
from tallybook.llm import queries


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def test_all_are_registered():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    expected = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted(expected, key=str)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
