"""Records of CSV files that many tasks read at once, though quotes may hold line breaks.

A line says nothing about whether it begins inside quotes; but it turns either of the two states it may
begin in into the state it ends in, and such steps compose. Every block of some thousand lines composes its
lines, the blocks of a file are composed in order (one small row each), and then each line knows its
state and each record its lines. Lines that are a record of their own, nearly all, are never grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: States of the reader after a piece of text: outside quotes, inside, right after a quote that closed.
_OUT, _IN, _CLOSED = 0, 1, 2
#: Bits of the number of lines that are put in order at a time; so many a window keeps without a sorter of its own.
BLOCK_BITS = 12


def _state_after(line: Column, inside: bool) -> Column:
    """Whether a line ends inside quotes, if it begins outside or inside.

    A quote opens a value at the start of a field only, anything else outside is text; inside, two quotes are one.
    """

    def step(state: Column, piece: Column) -> Column:
        """The quote that follows a piece of text."""
        text, first = piece["text"], piece["first"]
        starts = text.endswith(",") | (first & (text == ""))
        return (
            F.when(state == _IN, _CLOSED)
            .when((state == _CLOSED) & (text == ""), _IN)
            .when(starts, _IN)
            .otherwise(_OUT)
        )

    texts = F.split(line, '"')
    before = F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda t, i: F.struct(t.alias("text"), (i == 0).alias("first")))
    if inside:
        # what stands before the first quote is inside, so no field starts there
        before = F.transform(before, lambda p: F.struct(p["text"].alias("text"), F.lit(False).alias("first")))
    return F.aggregate(before, F.lit(_IN if inside else _OUT), step) == _IN


def _composed(df: DataFrame, before, through) -> DataFrame:
    """Per row, the state before it as far as known: ``fixed`` (if an earlier row leaves only one state) and ``swaps``.

    ``a`` and ``b`` are the states a row ends in, begun outside and inside. Where they are equal the past is
    forgotten; where they are the other way round the state is swapped.
    """
    swap = (F.col("a") & ~F.col("b")).cast("long")
    df = df.withColumn("swapped", F.sum(swap).over(through))
    forgets = F.when(F.col("a") == F.col("b"), (F.col("a").cast("long") + F.col("swapped")) % 2)
    df = df.withColumn("forgets", forgets)
    return df.withColumns(
        {
            "swaps": F.coalesce(F.sum(swap).over(before), F.lit(0)),
            "fixed": F.last("forgets", ignorenulls=True).over(before),
        }
    ).drop("swapped", "forgets")


def _resolved(start: Column) -> Column:
    """Whether a row begins inside quotes, given that of the first row of its group."""
    return (F.coalesce(F.col("fixed"), start.cast("long")) + F.col("swaps")) % 2 == 1


def read_records(spark: SparkSession, path) -> DataFrame:
    """The records of CSV files as text: ``file``, ``first`` (is it the file's first), ``record``, ``open``.

    Line breaks inside quotes are kept as they are; ``\\r`` before the line break that ends a record goes, empty lines
    outside quotes are passed over. If a file ends inside quotes, the record that opens them cannot
    be told from the rest of the file: only its first line is returned, as ``open``. Ranges of a file
    (``spark.sql.files.maxPartitionBytes``) are cut into blocks of lines, which tasks share out evenly; compressed files are one range.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("at"),
            # ascending within a range, as a task reads it from its beginning
            F.monotonically_increasing_id().alias("n"),
            F.col("value").alias("line"),
        )
        .withColumn("block", F.shiftright("n", BLOCK_BITS))
    )
    quoted = F.col("line").contains('"')
    lines = lines.withColumns(
        {
            "a": F.when(quoted, _state_after(F.col("line"), False)).otherwise(False),
            "b": F.when(quoted, _state_after(F.col("line"), True)).otherwise(True),
        }
    )
    in_block = Window.partitionBy("block", "at", "file").orderBy("n")
    lines = _composed(lines, in_block.rowsBetween(Window.unboundedPreceding, -1), in_block)

    # one row a block, for either state it may begin in: the state it ends in, and its last line that begins a record
    def state(start: int) -> Column:
        return _resolved(F.lit(start))

    full = ~F.col("line").isin("", "\r")
    blocks = lines.groupBy("block", "at", "file").agg(
        *[F.max_by(F.when(state(s), F.col("b")).otherwise(F.col("a")), "n").alias(name) for s, name in enumerate("ab")],
        *[F.max(F.when(~state(s), F.col("n"))).alias(f"start_{s}") for s in (0, 1)],
        F.min(F.when(full, F.col("n"))).alias("first_full"),
    )
    in_file = Window.partitionBy("file").orderBy("at", "block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = _composed(blocks, earlier, in_file).withColumn("begins", _resolved(F.lit(0)))
    blocks = blocks.withColumns(
        {
            "start": F.when(F.col("begins"), F.col("start_1")).otherwise(F.col("start_0")),
            "cut_off": F.last(F.when(F.col("begins"), F.col("b")).otherwise(F.col("a"))).over(everywhere),
        }
    ).select(
        "block",
        "at",
        "file",
        "begins",
        F.last("start", ignorenulls=True).over(earlier).alias("carried"),
        F.first("first_full", ignorenulls=True).over(everywhere).alias("header"),
        F.when(F.col("cut_off"), F.last("start", ignorenulls=True).over(everywhere)).alias("unclosed"),
    )

    lines = lines.join(blocks, ["block", "at", "file"])
    inside = _resolved(F.col("begins"))
    lines = lines.select(
        "file", "at", "block", "n", "line", "header", "carried", "unclosed",
        F.when(~inside, F.col("n")).alias("start"),
        F.when(inside, F.col("b")).otherwise(F.col("a")).alias("goes_on"),
    )
    lines = lines.withColumn("key", F.coalesce(F.last("start", ignorenulls=True).over(in_block), F.col("carried")))
    open_ = F.coalesce(F.col("key") == F.col("unclosed"), F.lit(False))
    one = F.col("start").isNotNull() & (~F.col("goes_on") | open_)

    first = (F.col("key") == F.col("header")).alias("first")
    alone = lines.filter(one).select("file", first, F.col("line").alias("record"), open_.alias("open"))
    joined = (
        lines.filter(~one & ~open_)
        .groupBy("file", "key", "header")
        .agg(F.sort_array(F.collect_list(F.struct("at", "n", "line"))).alias("lines"))
        .select("file", first, F.array_join(F.col("lines.line"), "\n").alias("record"), F.lit(False).alias("open"))
    )
    records = alone.unionByName(joined)
    ended = F.when(F.col("record").endswith("\r"), F.substring("record", F.lit(1), F.length("record") - 1))
    return records.withColumn("record", F.coalesce(ended, F.col("record"))).filter("record <> ''")
