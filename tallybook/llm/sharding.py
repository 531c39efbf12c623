"""Sharding by sampled splitters: records are ranged by key, so that all shards hold nearly the same bytes.

Keys are drawn with a chance proportional to record size; quantiles of the sample split
the key order into many ranges of about equal size. A range that turns out overfull is
sampled again and subdivided. Sizes are then summed exactly per range, and a running sum inside
each range places every record on one line from 0 to the total; shard boundaries divide
that line evenly, so a shard differs from another by at most about one record.

The key is (hash of the text, hash of the id, a row number): equal texts stand together and
stay together unless a boundary falls among them, and a group of copies of any size is split by
the later parts of the key. Only splitters and totals per range (at most ``MAX_RANGES``) reach
the driver. All steps are DataFrame functions.

Defined results: a null text has no bytes (size 16) and the checksum of no bytes; null and
repeated ids are records of their own; an empty table gives no rows; other columns are left
out unless named in ``keep``, which must not use the names of result columns.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.tables import stored

#: Bytes a record takes besides its text.
OVERHEAD = 16
RANGES_PER_SHARD, MAX_RANGES = 16, 65_536
ROWS_PER_RANGE = 1_000_000
#: Expected number of sampled keys a range.
SAMPLES = 16
#: A range with more than this many times the even share of bytes is overfull.
OVERFULL = 2.5
ROUNDS = 5
_KEY = ("h", "t", "i")
RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _longs(values: list[int]) -> Column:
    """The values as one constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """The number of splitters that are not above a record's key, by binary search."""
    if not splitters:
        return F.lit(0)
    depth = len(splitters).bit_length()
    top = (1 << 63) - 1
    padded = [*splitters, *[(top, top, top)] * ((1 << depth) - 1 - len(splitters))]
    parts = [_longs([s[k] for s in padded]) for k in range(3)]

    def not_above(at: Column) -> Column:
        h, t, i = (F.get(p, at) for p in parts)
        later = (t < F.col("t")) | ((t == F.col("t")) & (i <= F.col("i")))
        return (h < F.col("h")) | ((h == F.col("h")) & later)

    steps = F.array(*[F.lit(1 << k) for k in range(depth - 1, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda found, step: F.when(not_above(found + step - 1), found + step).otherwise(found)
    )


def _quantiles(rows: list, pieces: int) -> list[tuple[int, int, int]]:
    """Keys that cut the weighted sample into about equal pieces."""
    rows = sorted((tuple(r[k] for k in _KEY), r["weight"]) for r in rows)
    total, run, out = sum(w for _, w in rows), 0.0, []
    for key, weight in rows:
        if run > 0 and run >= total * (len(out) + 1) / pieces and len(out) < pieces - 1:
            out.append(key)
        run += weight
    return out


def _sampled(rows: DataFrame, rate: Column, seed: int) -> list:
    """Keys drawn with chance ``size * rate``; a record above 1 is surely drawn and weighs more."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *_KEY), F.lit(1 << 30)) / float(1 << 30)
    expected = F.col("size") * rate
    return rows.filter(draw < expected).select(*_KEY, F.greatest(expected, F.lit(1.0)).alias("weight")).collect()


def _splitters(rows: DataFrame, total: int, ranges: int) -> tuple[list[tuple[int, int, int]], dict[int, tuple[int, int]]]:
    """Splitters, and (bytes, rows) of each range they make."""
    share = total / ranges
    found = sorted(set(_quantiles(_sampled(rows, F.lit(SAMPLES / share), 0), ranges)))
    for attempt in range(1, ROUNDS + 1):
        ranged = rows.withColumn("range", _range_of(found))
        totals = {
            r["range"]: (r["bytes"], r["rows"])
            for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        }
        over = {k: math.ceil(b / share) for k, (b, n) in totals.items() if b > OVERFULL * share and n > 1}
        if not over or attempt == ROUNDS or len(found) + sum(over.values()) > 2 * MAX_RANGES:
            return found, totals
        rates = [0.0] * (len(found) + 1)
        for k, pieces in over.items():
            rates[k] = pieces * SAMPLES / totals[k][0]
        rate = F.get(F.split(F.lit(",".join(map(repr, rates))), ",").cast("array<double>"), F.col("range"))
        again: dict[int, list] = {}
        for r in _sampled(ranged, rate, attempt):
            again.setdefault(bisect_right(found, tuple(r[k] for k in _KEY)), []).append(r)
        found = sorted({*found, *(key for k, rs in again.items() for key in _quantiles(rs, over[k]))})
    raise AssertionError


def shard(docs: DataFrame, shards: int = 40, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each record's ``size``, ``text_crc32``, ``shard`` and ``slot``, which counts from 0 in a shard without gaps.

    The law is ``bytes``; ``grown_shard`` is null, since boundaries move when shards are added.
    """
    if clash := {*RESULT, *_KEY, "range"}.intersection(keep):
        raise ValueError(f"columns to keep have names of result columns: {sorted(clash)}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    records = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("h"),
            F.xxhash64("doc_id").alias("t"),
            F.monotonically_increasing_id().alias("i"),
            *[F.col(f"`{c}`") for c in keep],
        ),
        "records",
    )
    whole = records.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total, rows = whole["bytes"] or 0, whole["rows"]
    ranges = min(MAX_RANGES, max(shards * RANGES_PER_SHARD, rows // ROWS_PER_RANGE))
    splitters, totals = _splitters(records.select("size", *_KEY), total, ranges) if rows else ([], {})

    bytes_before, rows_before, b, n = [], [], 0, 0
    for k in range(len(splitters) + 1):
        bytes_before.append(b)
        rows_before.append(n)
        b, n = b + totals.get(k, (0, 0))[0], n + totals.get(k, (0, 0))[1]
    inside = Window.partitionBy("range").orderBy(*_KEY)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # twice the middle of the record on the line from 0 to the total
    middle = 2 * (F.get(_longs(bytes_before), F.col("range")) + F.sum("size").over(upto)) - F.col("size")
    placed = stored(
        records.withColumn("range", _range_of(splitters))
        .withColumn("place", F.get(_longs(rows_before), F.col("range")) + F.row_number().over(inside) - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2.0 * max(1, total)))).cast("int"))
        .drop("range", *_KEY),
        "placed",
    )
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    starts = _longs([first.get(s, 0) for s in range(shards)])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.get(starts, F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"`{c}`") for c in keep],
    )
