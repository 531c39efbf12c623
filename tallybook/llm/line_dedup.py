"""Line deduplication over overlapping windows of three lines.

Each three consecutive lines of a document are hashed to 128 bits. A window that occurs more
than once is kept where it occurs first, by document id (nulls last), then a hash of the text,
then line; every other occurrence covers its three lines, and covered lines are removed.

Documents are told apart by id and text: rows that repeat both are one document, and all of
them get its result. Defined results: lines are what stands between ``\\n``; a window of blank
lines alone counts as none; a document of fewer than three lines, an empty or a null text
stays as it is (a null text has 0 lines); an empty table gives no rows; other columns are
kept, and replaced where they have the name of a result column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.tables import stored

WINDOW = 3
RESULT = ("n_lines", "n_removed")


def _windows(docs: DataFrame) -> DataFrame:
    """(a, b) hashes of every window, with its document and first line."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n", -1).alias("lines"))
    hashed = lines.select(
        "doc_id",
        "h",
        F.size("lines").alias("n"),
        F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("b"),
        F.transform("lines", lambda x: F.length(F.trim(x)) > 0).alias("filled"),
    ).filter(F.col("n") >= WINDOW)

    def window(at):
        def of(name):
            return [F.get(F.col(name), at + k) for k in range(WINDOW)]

        filled = of("filled")
        return F.struct(
            at.alias("line"),
            F.xxhash64(*of("a")).alias("a"),
            F.xxhash64(*of("b")).alias("b"),
            (filled[0] | filled[1] | filled[2]).alias("filled"),
        )

    each = F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), window)
    return hashed.select("doc_id", "h", F.inline(each)).filter("filled").drop("filled")


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences of windows cut from ``text``, and ``n_lines``, ``n_removed``."""
    kept = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text", *RESULT)]
    windows = _windows(docs.select("doc_id", "text"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "line")
    repeated = stored(
        windows.groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .filter("n > 1")
        .drop("n"),
        "repeated-windows",
    )
    covered = windows.join(repeated.hint("merge"), ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    # both joins grow with the corpus, so they are shuffles at every size; a document's own lines bound its set
    removed = stored(
        covered.groupBy("doc_id", "h").agg(F.collect_set("line").alias("starts")), "removed-lines"
    ).withColumnsRenamed({"doc_id": "id", "h": "hash"})
    joined = docs.join(
        removed.hint("merge"), docs["doc_id"].eqNullSafe(removed["id"]) & (F.xxhash64(docs["text"]) == removed["hash"]), "left"
    )
    lines, starts = F.split(docs["text"], "\n", -1), removed["starts"]
    cut = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (WINDOW - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut)
    text = F.array_join(F.transform(left, lambda at: F.get(lines, at)), "\n")
    has = starts.isNotNull()
    return joined.select(
        docs["doc_id"],
        F.when(has, text).otherwise(docs["text"]).alias("text"),
        *[docs[c] for c in kept],
        F.when(docs["text"].isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(has, F.size(F.array_distinct(cut))).otherwise(0).cast("long").alias("n_removed"),
    )
