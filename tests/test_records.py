"""CSV records found by many tasks, against the reader that takes a file whole."""

import random
import zlib
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tallybook.sources import book as B
from tallybook.sources.records import read_records

SPLIT = "spark.sql.files.maxPartitionBytes"
COLUMNS = "a string, b string, c string"
OPTIONS = {"multiLine": True, "escape": '"'}


@contextmanager
def parts_of(spark, size):
    """Files are read in ranges of so many bytes."""
    before = {name: spark.conf.get(name) for name in (SPLIT, "spark.sql.files.openCostInBytes")}
    spark.conf.set(SPLIT, size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def fields(spark, path):
    parsed = F.from_csv("record", COLUMNS, OPTIONS)
    return sorted(map(str, read_records(spark, path).select(parsed.alias("r")).select("r.*").collect()))


def whole(spark, path):
    return sorted(map(str, spark.read.schema(COLUMNS).options(**OPTIONS).csv(path).collect()))


def random_field(r):
    # no returns: where one stands before the first line break, inside quotes or not, the other reader
    # takes single line breaks for text from there on
    text = "".join(r.choice(["x", "yz", ",", '"', "\n", "\n\n", " ", "é"]) for _ in range(r.randint(0, 6)))
    if any(c in text for c in ',"\n\r') or r.random() < 0.3:
        return '"' + text.replace('"', '""') + '"'
    # a quote inside a bare field is text
    return text + r.choice(["", "", 'a"b', 'a""'])


@pytest.mark.parametrize("seed", range(3))
def test_ranges_of_a_file_read_as_the_whole_file_does(spark, tmp_path, seed):
    r = random.Random(zlib.crc32(str(seed).encode()))
    for i in range(3):
        lines = [",".join(random_field(r) for _ in range(3)) for _ in range(r.choice([1, 150]))]
        (tmp_path / f"{i}.csv").write_bytes((r.choice(["\n", "\n\n"]).join(lines) + r.choice(["", "\n"])).encode())
    want = whole(spark, str(tmp_path))
    with parts_of(spark, (40, 300, 5000)[seed]):
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1
        got = fields(spark, str(tmp_path))
    assert got == want


def test_a_record_over_many_ranges_and_one_with_returns(spark, tmp_path):
    long = "\n".join(f"line {i}, with a comma" for i in range(200))
    (tmp_path / "a.csv").write_bytes(f'1,"{long}",x\r\n2,"two\r\nlines",y\r\n\r\n3,,"z"\r\n'.encode())
    with parts_of(spark, 100):
        got = {r.record for r in read_records(spark, str(tmp_path)).collect()}
    assert got == {f'1,"{long}",x', '2,"two\r\nlines",y', '3,,"z"'}


def test_the_lines_of_one_range_are_put_in_order_by_many_tasks(spark, tmp_path):
    # quotes are open over more than one block of lines
    long = "\n".join(f"line {i}" for i in range(10_000))
    lines = [f"{i},x,y" for i in range(40_000)]
    (tmp_path / "a.csv").write_text("\n".join([*lines[:20_000], f'a,"{long}",b', *lines[20_000:]]) + "\n")
    name, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(name, "false")
    try:
        got = read_records(spark, str(tmp_path)).select("record", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(r.record for r in got) == sorted([*lines, f'a,"{long}",b'])
    assert len({r.task for r in got if '"' not in r.record}) > 1


def test_first_records_and_quotes_never_closed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\na,"b\nb",c\n1,2,3\n')
    (tmp_path / "b.csv").write_text('a,b,c\n1,"2\n3"\n4,"5\n' + "6,7,8\n" * 50)
    (tmp_path / "c.csv").write_text("")
    with parts_of(spark, 30):
        got = sorted((r.file[-5:], r.first, r.record, r.open) for r in read_records(spark, str(tmp_path)).collect())
    assert got == [
        ("a.csv", False, "1,2,3", False),
        ("a.csv", True, 'a,"b\nb",c', False),
        ("b.csv", False, '1,"2\n3"', False),
        ("b.csv", False, '4,"5', True),
        ("b.csv", True, "a,b,c", False),
    ]


def test_one_big_file_is_loaded_by_many_tasks(spark, tmp_path):
    texts = {
        "accounts": "aid,kind,name,description\n" + "".join(f'{i},asset,"A\n{i}",\n' for i in range(300)),
        "transactions": 'tid,date,description\n1,2017-01-01,"never\n2,2017-01-02,closed\n',
        "splits": "sid,tid,aid,kind,amount,memo\n" + "".join(f'{i},1,{i},debit,1.00,"m ""{i}""\n,"\n' for i in range(300)) + "7,1\n",
    }
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "one.csv").write_text(text)
    with parts_of(spark, 1000):
        ledger, violations = B.bulk_load(spark, {name: str(tmp_path / name) for name in texts})
        assert sorted((r.table_name, r.problem, r.found) for r in violations.collect()) == [
            ("splits", "wrong number of fields", "7,1"),
            ("transactions", "quotes never closed", '1,2017-01-01,"never'),
        ]
        assert {tuple(r) for r in ledger.accounts.collect()} == {(i, "asset", f"A\n{i}", None) for i in range(300)}
        assert {r.memo for r in ledger.splits.collect()} == {f'm "{i}"\n,' for i in range(300)}


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tid,date,description\n1,2017-01-01,x\n")
    (tmp_path / "b.csv").write_text("tid,description,date\n1,x,2017-01-01\n")
    lines = B._read_lines(spark, "transactions", str(tmp_path), True, True)
    with pytest.raises(Exception, match="files with other columns"):
        lines.collect()
