import zlib

import pytest
from pyspark.sql import functions as F

from tallybook.llm import sharding


def placed(docs, shards, **options):
    return [r.asDict() for r in sharding.shard(docs, shards, **options).collect()]


def check(rows, docs, shards, slack=None):
    """Gapless slots, right sizes and checksums, and shards whose bytes differ by little more than a record."""
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(by_shard) <= set(range(shards))
    for members in by_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    expected = sorted(
        (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs
    )
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == expected
    if rows:
        sizes = [sum(r["size"] for r in by_shard.get(s, [])) for s in range(shards)]
        largest = max(r["size"] for r in rows)
        assert max(sizes) - min(sizes) <= 2 * largest


def test_sizes_are_near_equal(spark, documents):
    docs = [(i, "x" * (i * 37 % 400) + "é") for i in range(3000)]
    check(placed(documents(docs, 4), 7), docs, 7)


def test_hot_groups_and_repeated_rows_are_split(spark, documents):
    docs = [(i, "one text for many") for i in range(1000)] + [(5, "same id")] * 1000 + [(i, str(i)) for i in range(1000)]
    rows = placed(documents(docs, 4), 8)
    check(rows, docs, 8)
    assert len({r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(b"one text for many")}) > 1


def test_equal_texts_stand_together(spark, documents):
    docs = [(i, f"text {i % 100}") for i in range(1000)]
    shards = {}
    for r in placed(documents(docs), 5):
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 4


@pytest.mark.parametrize("docs", [[], [(1, None)], [(None, ""), (None, ""), (1, "a"), (1, "a")]])
def test_small_tables(spark, documents, docs):
    check(placed(documents(docs), 4), docs, 4)


def test_overfull_ranges_are_subdivided(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES", 1)
    monkeypatch.setattr(sharding, "OVERFULL", 1.2)
    docs = [(i, "y" * (i % 50)) for i in range(2000)]
    check(placed(documents(docs), 6), docs, 6)


def test_a_very_long_text(spark, documents):
    docs = [(0, "z" * 3_000_000)] + [(i, "short") for i in range(1, 500)]
    rows = placed(documents(docs), 5)
    assert sum(r["size"] for r in rows) == 3_000_016 + 499 * 21


def test_main_path_is_native(spark, documents):
    docs = documents([(1, "a"), (2, "b")])
    plan = sharding.shard(docs, 3)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_kept_columns(spark, documents):
    docs = documents([(1, "a"), (2, "b")])
    assert {(r["doc_id"], r["text"]) for r in sharding.shard(docs, 2, keep=("text",)).collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(ValueError):
        sharding.shard(docs.withColumn("slot", F.lit(1)), 2, keep=("slot",))
