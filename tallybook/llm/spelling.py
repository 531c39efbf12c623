"""Grouping spelling variants: words one edit apart, found by dynamic programming along sorted lists.

Words are counted over all texts. Two words one edit apart agree before and after it, so for the
length c of the shorter one and any cut of 0..c into intervals, they agree on all but the interval
the edit is in. Words of length c and c + 1 are therefore dealt by (c, interval, what is outside of it);
two intervals at first, halved for groups of over ``LIMIT`` words, down to one letter, where the
alphabet bounds a group. A pair counts in the interval its first difference is in, hence once.

Within a group the letters inside the interval are a sorted list. Each word's edit matrix, the three
diagonals that can hold a distance of at most one, is carried along the list by its adjacent longest
common prefixes: a row is computed once for all entries that share the prefix, and a range whose
row has no cell of at most one is skipped. All words of many groups advance together, a letter at a
time; array code takes the place of a loop over entries.

Defined results: null and empty texts have no words; a null id is an empty one in the rule of the
query; repeated rows count as often as they are there; ties for the most frequent neighbour go to the
smallest word by code points; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.tables import stored

#: What the query takes as words.
LENGTH, OCCURRENCES, RATIO, SPOILED = 5, 3, 2, 97
#: Words of a group beyond which its interval is halved; it changes no result.
LIMIT = 1 << 14
#: Words a task counts before it hands them on, rows searched together, and letters of an interval
#: after which the words of a range are compared one by one.
COUNTED, ROWS, DEEPEST = 1 << 18, 1 << 15, 64

#: Letters are A-Z, a-z and all of U+00C0 to U+00FF; A-Z become small, anything else a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def letter_runs(text: str) -> list[bytes]:
    """Runs of letters, A-Z as small ones, a byte for each code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _spoiled(runs: dict[bytes, int], doc_id: int | None, every: int) -> Iterator[tuple[bytes, int]]:
    """The rule of the query: where ``every`` divides the CRC-32 of ``<doc_id>:<run>``, a letter is lost."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, least: int = LENGTH, spoil: int | None = None) -> DataFrame:
    """(word, n): how often each run of at least ``least`` letters occurs; summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in found], pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = Counter(letter_runs(text.as_py() or ""))
                for word, n in runs.items() if spoil is None else _spoiled(runs, doc_id, spoil):
                    if len(word) >= least:
                        found[word] += n
                if len(found) >= COUNTED:
                    yield flush()
        if found:
            yield flush()

    parts = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


# -- dealing words into groups ------------------------------------------------------------

GROUP = ("c", "s", "e", "rest")


def _within(word, c, s, e) -> tuple:
    """What a word has outside of the interval [s, e) of class ``c``, and inside."""
    after = c - e
    rest = F.concat(F.substring(word, F.lit(1), s), F.substring(word, F.length(word) - after + 1, after))
    return rest.alias("rest"), F.substring(word, s + 1, F.length(word) - after - s).alias("middle")


def _dealt(words: DataFrame, least: int) -> DataFrame:
    """Every word in its first groups: as the shorter of a pair, and as the longer one, by either half."""
    length = F.length("word")
    classes = F.filter(F.array(length, length - 1), lambda c: c >= least)
    each = words.select("word", "n", F.explode(classes).alias("c"))
    half = F.floor(F.col("c") / 2).cast("int")
    spans = F.array(F.struct(F.lit(0).alias("s"), half.alias("e")), F.struct(half.alias("s"), F.col("c").alias("e")))
    each = each.select("word", "n", "c", F.explode(spans).alias("span")).select("word", "n", "c", "span.s", "span.e")
    return each.select("c", "s", "e", *_within(F.col("word"), *map(F.col, GROUP[:3])), "n")


def _halved(rows: DataFrame) -> DataFrame:
    """Rows of groups that are too large, dealt anew by the halves of their interval."""
    whole = F.concat(F.expr("left(rest, s)"), F.col("middle"), F.expr("substring(rest, s + 1)")).alias("word")
    cut = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
    spans = F.array(F.struct(F.col("s"), cut.alias("e")), F.struct(cut.alias("s"), F.col("e")))
    each = rows.select(whole, "n", "c", F.explode(spans).alias("span")).select("word", "n", "c", "span.s", "span.e")
    return each.select("c", "s", "e", *_within(F.col("word"), *map(F.col, GROUP[:3])), "n")


def _grouped(words: DataFrame, least: int, limit: int) -> DataFrame:
    """Every word in all its groups, each of at most ``limit`` words unless its interval is one letter."""
    rows, done = _dealt(words, least), []
    while True:
        sizes = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size"))
        large = stored(sizes.filter((F.col("size") > limit) & (F.col("e") - F.col("s") > 1)).select(*GROUP), "large-groups")
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, list(GROUP), "left_anti"))
        rows = _halved(rows.join(large, list(GROUP), "left_semi"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


# -- one edit within sorted lists -----------------------------------------------------------


def one_edit(a: np.ndarray, b: np.ndarray) -> tuple[bool, bool]:
    """Whether two arrays differ by one edit, and whether one begins with the other."""
    if len(a) > len(b):
        a, b = b, a
    differ = np.flatnonzero(a != b[: len(a)])
    if not len(differ):
        return len(b) == len(a) + 1, True
    k = int(differ[0])
    if len(a) == len(b):
        return len(differ) == 1, False
    return len(b) == len(a) + 1 and bool((a[k:] == b[k + 1 :]).all()), False


def near_in_lists(
    data: np.ndarray, offset: np.ndarray, length: np.ndarray, first: np.ndarray, deepest: int = DEEPEST
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows one edit apart within sorted lists, and whether one of them begins with the other.

    ``data`` holds the letters of all rows (no zeros), ``first`` is the first row of each row's list. Each pair
    comes both ways round.
    """
    m = len(length)
    padded = np.append(data, np.zeros(1, dtype=data.dtype))

    def letter(row: np.ndarray, at) -> np.ndarray:
        return np.where((at >= 0) & (at < length[row]), padded[np.minimum(offset[row] + np.maximum(at, 0), len(data))], 0)

    rows = np.arange(m)
    starts = first == rows
    after = np.append(rows[starts][1:], m)[np.cumsum(starts) - 1]  # where each row's list ends
    # longest common prefix with the row before, in the same list
    common = np.where(starts, -1, 0)
    live = rows[~starts]
    for d in range(deepest + 1):
        live = live[(length[live] > d) & (length[live - 1] > d)]
        live = live[letter(live, d) == letter(live - 1, d)]
        if not len(live):
            break
        common[live] = d + 1
    query, low, high = rows, first, after
    x = np.full(m, 2, dtype=np.int8)
    y = np.zeros(m, dtype=np.int8)
    z = np.where(length >= 1, 1, 2).astype(np.int8)
    same = np.ones(m, dtype=bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for d in range(deepest + 1):
        if not len(query):
            break
        # an entry that ends here stands first in its range
        gap = length[query] - d
        ended = length[low] == d
        last = np.choose(np.clip(gap + 1, 0, 3), [x, y, z, np.full_like(x, 2)])
        hit = ended & (gap >= -1) & (last == 1)
        found.append((query[hit], low[hit], same[hit]))
        low = low + ended
        keep = low < high
        query, low, high, x, y, z, same = (v[keep] for v in (query, low, high, x, y, z, same))
        if not len(query):
            break
        # the ranges of the next letter
        breaks = np.append(np.flatnonzero(common <= d), m)
        i, j = np.searchsorted(breaks, low), np.searchsorted(breaks, high)
        n = j - i
        k = np.repeat(i - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        query, x, y, z, same = (np.repeat(v, n) for v in (query, x, y, z, same))
        low, high = breaks[k], breaks[k + 1]
        own, size = letter(low, d), length[query]
        here = letter(query, d)
        x2 = np.where(d > size, 2, np.minimum(x + (own != letter(query, d - 1)), y + 1))
        y2 = np.where(d + 1 > size, 2, np.minimum(np.minimum(y + (own != here), z + 1), x2 + 1))
        z2 = np.where(d + 2 > size, 2, np.minimum(z + (own != letter(query, d + 1)), y2 + 1))
        same = same & ((own == here) | (d >= size))
        keep = np.minimum(np.minimum(x2, y2), z2) <= 1
        query, low, high, same = query[keep], low[keep], high[keep], same[keep]
        x, y, z = (np.minimum(v[keep], 2).astype(np.int8) for v in (x2, y2, z2))
    else:
        late = [
            (q, r, begins)
            for q, a, b in zip(query.tolist(), low.tolist(), high.tolist(), strict=True)
            for r in range(a, b)
            for near, begins in [
                one_edit(data[offset[q] : offset[q] + length[q]], data[offset[r] : offset[r] + length[r]])
            ]
            if near
        ]
        if late:
            found.append(tuple(np.array(c) for c in zip(*late, strict=True)))
    if not found:
        return rows[:0], rows[:0], rows[:0].astype(bool)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


NEAR = "word string, n_near long, near_n long, near string"


def _near_of_groups(table: pa.Table, first: np.ndarray) -> Iterator[tuple[str, int, int, str]]:
    """Per word with near ones in these groups: their number, and the most frequent one."""
    c, s, e = (table[name].to_numpy() for name in GROUP[:3])
    length = pc.utf8_length(table["middle"]).to_numpy().astype(np.int64)
    data = np.frombuffer("".join(table["middle"].to_pylist()).encode("latin-1"), dtype=np.uint8)
    a, b, begins = near_in_lists(data, np.cumsum(length) - length, length, first)
    # two words of the longer kind belong to the next class; where one begins with the other, the first
    # difference is beyond the interval unless that is the last one
    keep = ((length[a] == e[a] - s[a]) | (length[b] == e[b] - s[b])) & (~begins | (e[a] == c[a]))
    a, b = a[keep], b[keep]
    if not len(a):
        return
    n = table["n"].to_numpy()
    order = np.lexsort((-n[b], a))
    a, b = a[order], b[order]
    rest, middle, cut = table["rest"], table["middle"], s

    def word(row: int) -> str:
        outside = rest[row].as_py()
        return outside[: cut[row]] + middle[row].as_py() + outside[cut[row] :]

    begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    ends = np.append(begin[1:], len(a))
    for i, j in zip(begin.tolist(), ends.tolist(), strict=True):
        most = n[b[i]]
        tied = min(word(row) for row in b[i : i + int(np.searchsorted(-n[b[i:j]], -most, side="right"))].tolist())
        yield word(a[i]), j - i, int(most), tied


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group come in; groups are searched as soon as they are whole."""

    def searched(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = list(_near_of_groups(table, first))
        if found:
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, kind) for v, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=["word", "n_near", "near_n", "near"],
            )

    def firsts(table: pa.Table) -> np.ndarray:
        new = np.ones(len(table), dtype=bool)
        differ = np.zeros(len(table) - 1, dtype=bool)
        for name in GROUP:
            column = table[name]
            differ |= pc.not_equal(column[1:], column[:-1]).to_numpy()
        new[1:] = differ
        return np.maximum.accumulate(np.where(new, np.arange(len(table)), 0))

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        first = firsts(table)
        whole = int(first[-1])  # the last group may go on
        if whole:
            yield from searched(table.slice(0, whole).combine_chunks(), first[:whole])
        held = table.slice(whole).to_batches()
        rows = len(table) - whole
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from searched(table, firsts(table))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the last word reached by forms, by pointer doubling.

    A form is at least ``ratio`` >= 2 times as frequent, so a chain of forms is shorter than 64 and
    six rounds reach its end; fewer where nothing moves any more.
    """
    at = links.select("word", F.col("form").alias("root"))
    for _ in range(6):
        there = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(there, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return at


def group_variants(words: DataFrame, least: int = LENGTH, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n), each word of at least ``least`` letters.

    ``form`` is the most frequent word one edit away, if it is at least ``ratio`` (2 or more) times as
    frequent, ``root`` the word that forms lead to in the end, ``n_near`` the number of words one edit away.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, or forms could lead in circles")
    words = stored(words, "vocabulary")
    rows = _grouped(words, least, limit)
    dealt = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "middle")
    near = dealt.mapInArrow(_near, NEAR)
    best = near.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("by"), "near")).alias("best")
    )
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.by") >= ratio * F.col("n")
    judged = stored(
        joined.select(
            "word",
            F.when(is_form, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("best.by")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The registered query: words of at least five letters and three occurrences, by its rule."""
    counts = word_counts(docs, spoil=SPOILED)
    return group_variants(counts.filter(F.col("n") >= OCCURRENCES))
