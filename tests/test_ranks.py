"""Numbers without gaps, against a sort."""

import random

import pytest
from micro_ledger import rows
from pyspark.sql import functions as F

from tallybook.operators import edits, ranks
from tallybook.operators.session import Session

EXTREME = [-(2**63), -(2**63) + 1, -(2**44), -1, 0, 1, 2**22 - 1, 2**22, 2**44, 2**62, 2**63 - 1]


@pytest.mark.parametrize("chunk", [1 << 16, 2])
def test_numbers_are_places_in_the_order(spark, monkeypatch, chunk):
    monkeypatch.setattr(ranks, "_CHUNK", chunk)
    r = random.Random(7)
    pairs = [(r.choice(EXTREME + [r.randint(0, 20)] * 8), r.choice([5, 5, 7, -(2**63)])) for _ in range(400)]
    got = ranks.numbered(spark.createDataFrame(pairs, "seq long, tid long"), "seq", "tid")
    assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == [(*p, i) for i, p in enumerate(sorted(pairs))]


def test_no_rows_and_no_values(spark):
    assert ranks.numbered(spark.createDataFrame([], "seq long"), "seq").isEmpty()
    got = ranks.numbered(spark.createDataFrame([(None,), (None,), (3,)], "seq long"), "seq")
    assert sorted(r.number for r in got.collect()) == [0, 1, 2]


def test_a_value_of_most_rows_is_one_row_until_it_is_numbered(spark):
    many = spark.range(0, 300_000).select(F.when(F.col("id") % 3 > 0, F.lit(9)).otherwise(F.col("id")).cast("long").alias("seq"))
    got = ranks.numbered(many, "seq")
    stats = got.agg(F.count("*"), F.min("number"), F.max("number"), F.count_distinct("number")).first()
    assert tuple(stats) == (300_000, 0, 299_999, 300_000)
    assert got.filter("seq = 9").agg(F.max("number") - F.min("number") + 1).first()[0] == 200_001


def test_gapless_inserts(spark, micro):
    far = spark.createDataFrame([(2**62,), (-(2**62),), (7,), (7,)], "seq long")
    accounts = edits.insert_accounts(micro, far, gapless=True)
    assert sorted(rows(accounts.inserted, "id", "seq")) == [(9, -(2**62)), (10, 7), (11, 7), (12, 2**62)]
    assert accounts.ledger.accounts.count() == 12
    wanted = spark.createDataFrame([(5, 9), (5, 2), (1, 77), (9, None)], "seq long, tid long")
    splits = edits.insert_splits(micro, wanted, gapless=True)
    top = micro.splits.agg(F.max("sid")).first()[0]
    assert sorted(rows(splits.rows["splits"], "sid", "tid")) == [(top + 1, 2), (top + 2, 9), (top + 3, 1)]
    assert rows(splits.rejects, "seq", "reason") == [(1, "no transaction with this id")]


def test_gapless_inserts_in_a_session(spark, micro):
    session = Session(micro).insert_transactions(spark.createDataFrame([(3,), (3,), (900,)], "seq long"), "2017-06-01", gapless=True)
    assert sorted(rows(session.inserted, "id", "seq")) == [(10, 3), (11, 3), (12, 900)]
