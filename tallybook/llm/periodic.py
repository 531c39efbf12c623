"""Periodic runs of words, and texts with their repetitions collapsed.

A run is a stretch of consecutive words of smallest period q (words q apart are identical), at least
``max(LEAST, TIMES * q)`` words long, that no neighbouring word extends. For each period p every
2p-th word is probed (a harmonic grid: some ``n log n / 2`` probes in all): a run holds a probed word
whose common extension with the word p later is at least p long, and the extension gives its
end. Its begin, less than 2p words before, is found by halving. Extensions come from
``common_extension``; documents are independent, so nothing is shuffled.

Defined results: a null or empty text, or one of white space, has no words and no runs; rows are
independent, so repeated rows repeat their results; a null id is carried; texts are
read whole; an empty table gives no rows; other columns are kept, and replaced where they have
the name of a result column.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.common_extension import CommonExtension
from tallybook.llm.tables import with_columns_in_arrow

#: The shortest run, and how many periods it holds at least.
LEAST, TIMES = 6, 4
#: Words that are searched together, and probes that are made at a time; neither changes a result.
WORDS, PROBES = 1 << 17, 1 << 19

Run = tuple[int, int, int]  # start, length, period


def _probes(lengths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Probed places, their periods, and the first place of their documents, in blocks."""
    periods = lengths // TIMES
    document = np.repeat(np.arange(len(lengths)), periods)
    p = np.arange(len(document)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    places = (lengths[document] - p - 1) // (2 * p) + 1
    ends = np.cumsum(places)
    at = 0
    while at < len(p):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PROBES, side="right")))
        n = places[at:to]
        period = np.repeat(p[at:to], n)
        nth = np.arange(len(period)) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(starts[document[at:to]], n)
        yield first + 2 * period * nth, period, first
        at = to


def _runs_of(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, period) of every run of all documents, by start and then period."""
    extension = None
    found = [np.empty((3, 0), dtype=np.int64)]
    for at, p, first in _probes(lengths, starts):
        same = words[at] == words[at + p]
        at, p, first = at[same], p[same], first[same]
        if not len(at):
            continue
        extension = extension or CommonExtension(words, starts)
        reach = extension.of(at, at + p)
        keep = reach >= p
        at, p, first, reach = at[keep], p[keep], first[keep], reach[keep]
        # of the probed words of one run, the first
        back = at - 2 * p
        again = np.zeros(len(at), dtype=bool)
        has = np.flatnonzero(back >= first)
        again[has] = extension.of(back[has], back[has] + p[has]) >= 2 * p[has]
        at, p, first, reach = at[~again], p[~again], first[~again], reach[~again]
        low, high = np.maximum(first, at - 2 * p + 1), at.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            joined = extension.of(middle, middle + p[open_]) >= at[open_] - middle
            high[open_] = np.where(joined, middle, high[open_])
            low[open_] = np.where(joined, low[open_], middle + 1)
        end = at + reach + p
        long_enough = end - high >= np.maximum(LEAST, TIMES * p)
        found.append(np.stack([high, end, p])[:, long_enough])
    start, end, p = np.concatenate(found, axis=1)
    # a stretch found with several periods has the smallest one
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[new], end[new], p[new]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def find_runs(documents: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each list of words, by start and then period."""
    out: list[list[Run]] = [[] for _ in documents]
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    numbers: list[np.ndarray] = []
    which = [i for i, words in enumerate(documents) if len(words) >= LEAST]
    for k, i in enumerate(which):
        numbers.append(np.fromiter(map(known.__getitem__, documents[i]), dtype=np.int64, count=len(documents[i])))
        numbers.append(np.array([-1 - k]))
    if not which:
        return out
    lengths = np.array([len(documents[i]) for i in which])
    starts = np.cumsum(lengths + 1) - lengths - 1
    start, end, p = _runs_of(np.concatenate(numbers), starts, lengths)
    owner = np.searchsorted(starts, start, side="right") - 1
    for k, a, b, q in zip(owner.tolist(), start.tolist(), end.tolist(), p.tolist(), strict=True):
        out[which[k]].append((a - int(starts[k]), b - a, q))
    return out


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def as_given(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def with_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The rule of the query: every tenth document, by the CRC-32 of its id, ends in a run.

    A document without an id stays as it is.
    """
    n = len(words)
    if doc_id is None or not n:
        return words
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def _mapped(docs: DataFrame, column: str, new: T.StructType, change, result: Callable, drop: tuple[str, ...]) -> DataFrame:
    """``docs`` with the columns that ``result`` makes of each row's words and runs."""

    def worker():
        def make(columns):
            rows, held, size = [], [], 0

            def search():
                rows.extend(result(w, r) for w, r in zip(held, find_runs(held), strict=True))
                held.clear()

            for doc_id, text in zip(columns[0].to_pylist(), columns[1], strict=True):
                # bytes.split() splits at space and the control characters 9 to 13
                words = change(doc_id, (text.as_py() or "").encode().split())
                if held and size + len(words) > WORDS:
                    search()
                    size = 0
                held.append(words)
                size += len(words)
            search()
            return list(zip(*rows, strict=True)) if rows else [[] for _ in new.fields]

        return make

    given = [docs["doc_id"].cast("long"), docs[f"`{column}`"].cast("string")]
    return with_columns_in_arrow(docs, given, new, worker, drop=drop)


def collapse(docs: DataFrame, column: str = "text", change=as_given) -> DataFrame:
    """``docs`` with ``runs``, array<struct<start, length, period>> in words, and ``collapsed``.

    The latter is the text's words without those that a run holds after its first period, joined by
    one space. ``change`` (doc_id, words) may alter the words first.
    """
    run = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    new = T.StructType().add("runs", T.ArrayType(run)).add("collapsed", "string")

    def result(words, runs):
        shown = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]
        return shown, b" ".join(kept_words(words, runs)).decode("utf-8", "replace")

    return _mapped(docs, column, new, change, result, ())


def digest(docs: DataFrame, column: str = "text", change=as_given) -> DataFrame:
    """``docs`` without its text, with the longest run of each document and digests of all of them.

    Of equally long runs the one with the smallest start, then period. Without runs the four columns
    of the longest one are null.
    """
    new = T.StructType().add("n_runs", "long").add("start", "long").add("length", "long").add("period", "long")
    new.add("exponent_milli", "long").add("runs_sha256", "string").add("collapsed_sha256", "string")

    def result(words, runs):
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        texts = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()
        if not runs:
            return 0, None, None, None, None, *texts
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        return len(runs), start, length, period, 1000 * length // period, *texts

    return _mapped(docs, column, new, change, result, (column,))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The registered query: planted runs included, one row per document."""
    found = digest(docs.select("doc_id", F.col("text")), change=with_planted_run)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
