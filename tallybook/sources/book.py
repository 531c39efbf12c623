"""Books on storage: one folder per year, one sub-folder per published version.

    <root>/book_year=2017/attempt-<unique>/{accounts,transactions,splits,journal,counters,checkpoints}
    <root>/book_year=2017/versions/<number>.json      names the folder of that version

A version is written once and never changed, so readers of an older one are not
disturbed. A table that a batch leaves as it was stays in the folder it was written to, and the version's file names
that folder. Publishing is optimistic: a ledger remembers the version it was read from, every attempt
writes a folder of its own, and last of all the file of the next number is created, which only
one publisher can do. The others get a ``Conflict``, and their folders are removed; nobody's changes
are lost without notice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.ledger import Change, Ledger, Staged, Version
from tallybook.operators.changes import change_imbalances, change_problems, merged
from tallybook.operators.checks import (
    Conflict,
    refuse_imbalances,
    refuse_problems,
    require_balanced,
    require_no_fatal,
    require_valid,
    validate_schema,
)
from tallybook.operators.checkpoints import build_checkpoints
from tallybook.operators.journal import stored_counters, stored_journal
from tallybook.operators.scopes import shared_folder
from tallybook.session import shuffles_dropped
from tallybook.sources.records import read_records
from tallybook.sources.schema import CHECKPOINTS, COUNTERS, DEFAULT_YEAR, JOURNAL, KEYS, TABLES
from tallybook.sources.store import put_new, remove


def _book(root: str, year) -> str:
    return f"{root}/book_year={year}"


def published_versions(spark: SparkSession, root: str, year=DEFAULT_YEAR) -> DataFrame:
    """One row per published version: its number, its folder, and the version it was made from (0: none)."""
    schema = "version long, base long, has_journal boolean, folder string, shared map<string,string>"
    return spark.read.schema(schema).json(f"{_book(root, year)}/versions")


def _version(spark: SparkSession, root: str, year, version: int | None = None):
    """The row of a version, the newest one unless it is named; None if there is none."""
    try:
        known = published_versions(spark, root, year)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    if version is not None:
        known = known.filter(F.col("version") == version)
    return known.orderBy(F.desc("version")).first()


def read_book(spark: SparkSession, root: str, year=DEFAULT_YEAR, version: int | None = None) -> Ledger:
    """The ledger of one year, newest version unless one is named."""
    known = _version(spark, root, year, version)
    if known is None:
        raise ValueError(f"no published book of {year} under {root}")
    ledger = _read_folder(spark, f"{_book(root, year)}/{known['folder']}", known["has_journal"], _shared(root, year, known))
    return replace(ledger, version=Version(root, str(year), known["version"]), published=True)


def _shared(root: str, year, known) -> dict[str, str]:
    """The tables of a version that earlier versions wrote, with their folders."""
    return {name: f"{_book(root, year)}/{folder}" for name, folder in (known["shared"] or {}).items()}


def _read_folder(spark: SparkSession, folder: str, journal: bool, shared: dict[str, str] | None = None) -> Ledger:
    wanted, at = {**TABLES, **(JOURNAL_TABLES if journal else {})}, shared or {}
    return Ledger(
        **{name: spark.read.schema(schema).parquet(f"{at.get(name, folder)}/{name}") for name, schema in wanted.items()}
    )


def read_journal(ledger: Ledger, folder: str) -> Ledger:
    """The ledger with the journal tables that ``write_journal`` left under ``folder``."""
    read = ledger.splits.sparkSession.read
    return replace(ledger, **{name: read.schema(schema).parquet(f"{folder}/{name}") for name, schema in JOURNAL_TABLES.items()})


#: Tables that are made of the other three.
JOURNAL_TABLES = {"journal": JOURNAL, "counters": COUNTERS, "checkpoints": CHECKPOINTS}
#: Bytes of a file of a table, at most; and at least, as long as there are tasks to read more of them.
FILE_BYTES, LEAST_BYTES = 128 << 20, 1 << 20
#: Rows of a file, at most: a task sorts them before it writes, and in memory they are many times their bytes in a file.
FILE_ROWS = 1 << 21


#: Bits of each column in a place of two columns.
_PLACE_BITS = 12


def _place(rows: DataFrame, date: str, number: str) -> Column:
    """One number for the place of a row by two columns: the bits of both, turn by turn.

    Each column is cut into equal steps between its least and greatest value. A range of places is a
    small window of both columns, so files of such ranges can be skipped by either.
    """
    day, at = F.unix_date(F.col(date)).cast("long"), F.col(number)
    bounds = rows.agg(*[f(c) for c in (day, at) for f in (F.min, F.max)]).first()

    def step(value: Column, low: int | None, high: int | None) -> Column:
        if low is None:
            return F.lit(0).cast("long")
        part = (value.cast("double") - float(low)) / (float(high) - float(low) + 1.0)
        return F.coalesce(F.least(F.floor(part * (1 << _PLACE_BITS)), F.lit((1 << _PLACE_BITS) - 1)), F.lit(0)).cast("long")

    place = F.lit(0).cast("long")
    for offset, value in enumerate((step(at, *bounds[2:]), step(day, *bounds[:2]))):
        for bit in range(_PLACE_BITS):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(value, bit).bitwiseAND(F.lit(1).cast("long")), 2 * bit + offset))
    return place


def _write_ranges(
    rows: DataFrame,
    folder: str,
    name: str,
    keys: tuple[str, ...],
    order: tuple[str, ...],
    by: str | None = None,
    near: tuple[str, str] | None = None,
) -> None:
    """Write rows in ranges of ``keys``, each sorted by ``order``; in folders of a column's values if one is named.

    With ``near``, a date and a number, ranges go by the place of both before ``keys``.

    Finding the ranges reads the rows once more than writing them, so they are first written as
    they come; the number of ranges follows from their measured bytes, and their rows, which the files tell.
    """
    spark = rows.sparkSession
    with shuffles_dropped(spark):
        rows.write.parquet(f"{folder}/unsorted/{name}")
    raw = spark.read.schema(rows.schema).parquet(f"{folder}/unsorted/{name}")
    size = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES)
    files = max(-(-size // FILE_BYTES), -(-raw.count() // FILE_ROWS), least, 1)
    if near:
        raw, keys = raw.withColumn("place", _place(raw, *near)), ("place", *keys)
    ranges = raw.repartitionByRange(files, *keys).select(*rows.columns)
    with shuffles_dropped(spark):
        ranges.sortWithinPartitions(*order).write.partitionBy(*([by] if by else [])).parquet(f"{folder}/{name}")
    remove(spark, f"{folder}/unsorted/{name}")


def _write_tables(ledger: Ledger, folder: str, names=tuple(TABLES)) -> None:
    """Write the three tables, or some of them, each in the order its readers filter or group by.

    The range keys end in a unique id, so that a date or transaction holding a
    large part of all rows is spread over as many files as it needs.
    """
    if "accounts" in names:
        ledger.accounts.select(*TABLES["accounts"].names).write.parquet(f"{folder}/accounts")
    for name, keys in (("transactions", ("date", "tid")), ("splits", ("tid", "sid"))):
        if name not in names:
            continue
        _write_ranges(getattr(ledger, name).select(*TABLES[name].names), folder, name, keys, keys)


def write_journal(ledger: Ledger, folder: str) -> None:
    """Write the journal tables under ``folder``, for reports of some dates, some accounts, or both.

    Files of the journal are windows of dates and accounts; names and checkpoints go by date.
    """
    _write_ranges(stored_journal(ledger), folder, "journal", ("date", "sid"), ("date", "aid"), near=("date", "aid"))
    _write_ranges(stored_counters(ledger), folder, "counters", ("date", "tid", "side"), ("date", "tid", "side"))
    # from the journal as written; a folder per year
    dated = replace(ledger, journal=ledger.splits.sparkSession.read.schema(JOURNAL).parquet(f"{folder}/journal"))
    _write_ranges(build_checkpoints(dated), folder, "checkpoints", ("year", "aid"), ("year", "aid"), by="year")


def _stored_changes(staged: Staged, folder: str) -> dict[str, Change]:
    """What a batch changes, computed once and written under ``folder``."""
    spark = staged.ledger.splits.sparkSession
    changes = {}
    for name, schema in TABLES.items():
        key = KEYS[name]
        parts = {"rows": schema.names, "gone": [key]}
        if name not in staged.rows and name not in staged.gone:
            continue
        empty = spark.createDataFrame([], schema)
        for part, columns in parts.items():
            df = getattr(staged, part).get(name, empty).select(*columns)
            with shuffles_dropped(spark):
                df.write.parquet(f"{folder}/{name}_{part}")
            parts[part] = spark.read.schema(df.schema).parquet(f"{folder}/{name}_{part}")
        changes[name] = Change(**parts)
    return changes


def _base(spark: SparkSession, ledger: Ledger, root: str, year, overwrite: bool) -> int:
    """The number of the version a ledger may follow; 0 if the book has none."""
    newest = _version(spark, root, year)
    newest = newest["version"] if newest else 0
    mine = ledger.version
    if overwrite:
        return newest
    if mine is None or (mine.root, mine.year) != (root, str(year)):
        if newest:
            raise Conflict(f"Version {newest} of this book exists, and the ledger was not read from the book.")
    elif mine.number != newest:
        raise Conflict(f"Made from version {mine.number}, but version {newest} has been published.")
    return newest


def _unchanged(spark: SparkSession, base: Ledger, root: str, year, changes: dict[str, Change]) -> dict[str, str]:
    """The tables a batch leaves as they are, with the names of their folders in this book; none if its ledger is of another."""
    of = base.version
    if of is None or (of.root, of.year) != (root, str(year)):
        return {}
    known = _version(spark, root, year, of.number)
    return {name: (known["shared"] or {}).get(name, known["folder"]) for name in TABLES if name not in changes}


def publish(
    staged: Staged | Ledger, root: str, year=DEFAULT_YEAR, journal: bool = True, overwrite: bool = False
) -> Ledger:
    """Write a ledger as the book's next version, unless it is invalid or unbalanced.

    A staged batch comes with its rejects and is refused if one of them is fatal; a plain
    ledger has none. A ledger that was made from an older version than the newest one, or that was not
    read from this book though the book has versions, raises ``Conflict``: before anything is written where
    the newer version is there already, else when the version's number is taken.
    ``overwrite`` says that it is to replace whatever is newest when publishing starts.

    A batch made from a version as it was read, or a session on one, is published by its changes: they are
    stored, and only what they touch is checked, as that version was checked before; a table of the same book
    that they do not touch is not written again. Anything else
    is written whole and checked as written, keys and references included. Either way the changes behind the
    tables are computed once. The files of a refused attempt are removed. Returns the published ledger.
    """
    ledger = staged.ledger if isinstance(staged, Staged) else staged
    spark = ledger.splits.sparkSession
    base = _base(spark, ledger, root, year, overwrite)
    if isinstance(staged, Staged):
        require_no_fatal(staged.rejects)
    name, kept = f"attempt-{uuid.uuid4().hex}", {}
    folder = f"{_book(root, year)}/{name}"
    try:
        if isinstance(staged, Staged) and staged.base is not None and staged.base.published:
            changes = _stored_changes(staged, f"{folder}/changes")
            refuse_problems(change_problems(staged.base, changes))
            refuse_imbalances(change_imbalances(staged.base, changes))
            kept = _unchanged(spark, staged.base, root, year, changes)
            _write_tables(merged(staged.base, changes), folder, [n for n in TABLES if n not in kept])
            remove(spark, f"{folder}/changes")
            written = _read_folder(spark, folder, False, _shared(root, year, {"shared": kept}))
        else:
            _write_tables(ledger, folder)
            written = _read_folder(spark, folder, journal=False)
            require_valid(written)
            require_balanced(written)
        if journal:
            write_journal(written, folder)
        row = {"version": base + 1, "base": base, "has_journal": journal, "folder": name, "shared": kept}
        if not put_new(spark, f"{_book(root, year)}/versions/{base + 1:012d}.json", json.dumps(row)):
            raise Conflict(f"Version {base + 1} has been published meanwhile.")
    except BaseException:
        remove(spark, folder)
        raise
    done = _read_folder(spark, folder, journal, _shared(root, year, {"shared": kept}))
    return replace(done, version=Version(root, str(year), base + 1), published=True)


def publish_changes(
    spark: SparkSession,
    root: str,
    change: Callable[[Ledger], Staged | Ledger],
    year=DEFAULT_YEAR,
    attempts: int = 3,
    journal: bool = True,
) -> Ledger:
    """Read the newest version, apply ``change`` and publish; after a conflict, on the version that came between.

    The last of ``attempts`` raises its ``Conflict``. Any other refusal is raised at once.
    """
    for left in range(attempts - 1, -1, -1):
        try:
            return publish(change(read_book(spark, root, year)), root, year, journal)
        except Conflict:
            if not left:
                raise
    raise ValueError("attempts must be at least 1")


def store_unchecked(ledger: Ledger, folder: str, journal: bool = True) -> Ledger:
    """Write a working copy and read it back: a cut in the lineage, not a publication.

    Unbalanced ledgers are welcome; the folder should lie under ``shared_folder``.
    """
    spark = ledger.splits.sparkSession
    _write_tables(ledger, folder)
    if journal:
        write_journal(_read_folder(spark, folder, journal=False), folder)
    return _read_folder(spark, folder, journal)


def _read_lines(spark: SparkSession, name: str, path, header: bool, multi_line: bool) -> DataFrame:
    """The lines of one table's files as text columns, and ``broken``: the line, where its fields do not fit.

    ``open`` is whether the line opens quotes that its file never closes. With a header, columns go by
    their names; files of one table must name them in the same order.
    """
    schema = TABLES[name]
    options = {"multiLine": multi_line, "escape": '"', "header": header}
    columns = schema.names
    if header:
        columns = spark.read.options(**options).csv(path).columns
        unknown, missing = sorted(set(columns) - set(schema.names)), sorted(set(schema.names) - set(columns))
        if unknown or missing or len(columns) != len(schema.names):
            raise ValueError(f"{name}: unknown or repeated columns {unknown or columns}, missing columns {missing}")
    texts = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "broken"]])
    if multi_line:
        options = {"multiLine": True, "escape": '"', "columnNameOfCorruptRecord": "broken"}
        parsed = F.from_csv("record", texts.simpleString()[len("struct<") : -1].replace(":", " "), options)
        rows = read_records(spark, path).select("first", "record", "open", parsed.alias("fields"))
        if header:
            same = reduce(lambda a, b: a & b, [F.col(f"fields.{c}").eqNullSafe(F.lit(c)) for c in columns])
            text = F.concat(F.lit(f"{name}: files with other columns than {columns}: "), "record")
            rows = rows.filter(F.when(~F.col("first"), True).when(same, False).otherwise(F.raise_error(text).cast("boolean")))
        broken = F.when(F.col("open"), F.col("record")).otherwise(F.col("fields.broken"))
        return rows.select(*[F.col(f"fields.{c}").alias(c) for c in columns], broken.alias("broken"), "open")
    reader = spark.read.schema(texts).options(**options, enforceSchema=False, columnNameOfCorruptRecord="broken")
    return reader.csv(path).withColumn("open", F.lit(False))


def _unreadable(text: Column, kind: T.DataType) -> Column:
    """Whether a text is not a value of this type; an amount with more decimals than are kept is none."""
    bad = text.isNotNull() & text.try_cast(kind).isNull()
    if not isinstance(kind, T.DecimalType):
        return bad
    exact = text.try_cast(T.DecimalType(38, 18))
    longer = text.rlike(r"\.[0-9]{" + str(kind.scale) + r"}[0-9]*[1-9]")
    return bad | F.coalesce(longer | (exact != text.try_cast(kind)), F.lit(False))


def bulk_load(
    spark: SparkSession, files: dict[str, str], header: bool = True, multi_line: bool = True
) -> tuple[Ledger, DataFrame]:
    """Read CSV files of the three tables.

    ``files`` maps a table name to its path(s). With a header, columns are matched by name, and
    an unknown or missing one raises; without, they come in the order of the schema. Returns the
    ledger made of the lines that have a field for each column and whose every value can be
    read as its column's type, and the violations: lines with too few or too many
    fields, quotes that are never closed (what follows them in the file is not loaded), values that cannot be
    read or would be rounded, and broken column rules of the rest.

    ``multi_line`` allows line breaks inside quotes. Large files are split either way; with it their lines
    are shuffled once, to find out which of them begin inside quotes.
    """
    tables, unreadable = {}, []
    for name, schema in TABLES.items():
        # Read as text and cast here: every violation is then seen, whatever columns a query uses.
        lines = _read_lines(spark, name, files[name], header, multi_line)
        whole = F.col("broken").isNull()
        typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema if f.dataType != T.StringType()}
        bad = {c: _unreadable(F.col(c), schema[c].dataType) for c in typed}
        sound = reduce(lambda a, b: a & b, [whole, *[~test for test in bad.values()]])
        tables[name] = lines.filter(sound).select(*[typed.get(c, F.col(c)).alias(c) for c in schema.names])

        def problem(test: Column, column: Column, text: str, found: Column) -> Column:
            return F.when(
                test, F.struct(column.alias("column_name"), F.lit(text).alias("problem"), found.alias("found"))
            )

        no_column = F.lit(None).cast("string")
        problems = [
            problem(~whole & ~F.col("open"), no_column, "wrong number of fields", F.col("broken")),
            problem(F.col("open"), no_column, "quotes never closed", F.col("broken")),
        ]
        for c, test in bad.items():
            rounded = whole & test & typed[c].isNotNull()
            problems.append(problem(whole & test & ~rounded, F.lit(c), "unreadable value", F.col(c)))
            problems.append(problem(rounded, F.lit(c), "too many decimals", F.col(c)))
        key = F.when(whole, typed[KEYS[name]]).alias("key")
        unreadable.append(
            lines.select(key, F.explode(F.array_compact(F.array(*problems))).alias("p")).select(
                F.lit(name).alias("table_name"), "key", "p.*"
            )
        )
    ledger = Ledger(**tables)
    return ledger, reduce(DataFrame.unionByName, unreadable, validate_schema(ledger))


def append(ledger: Ledger, more: Ledger) -> Ledger:
    """A ledger with the rows of another one added."""
    return ledger.stage(**{n: getattr(ledger, n).unionByName(getattr(more, n)) for n in TABLES})
