"""Benchmark decontamination: passages of a benchmark found through an FM-index per shard of documents.

A shard is one Arrow batch of documents (bounded in rows and bytes by the session's Arrow
settings). Its words are numbered by the benchmark's vocabulary; a word that no item holds
matches nothing and becomes a separator, and stretches too short for any window are left
out, so the index holds exactly what can match. All windows are searched backward at
once, their occurrences located through sampled suffix positions, and the covered words of
each document merged into spans.

The benchmark is taken in blocks of bounded bytes, which are broadcast one after the other;
every block passes over all documents, and the spans of the passes are merged.

Defined results: null and empty texts have no words; items without words or without an id
take no part; repeated item ids count once; rows are judged one by one, so repeated rows and
ids repeat their results; a null id is carried; an empty benchmark hits nothing; other columns are
kept, and replaced where they have the name of a result column.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.fm_index import FMIndex
from tallybook.llm.tables import with_columns_in_arrow
from tallybook.llm.words import alnum_words

WINDOW = 13
#: Bytes of benchmark text that are searched for, and broadcast, at a time.
BLOCK_BYTES = 8 << 20
#: Occurrences that are located at a time.
LOCATED = 1 << 20

_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))


class Block:
    """Windows over a numbered vocabulary, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[at : at + window]), set()).add(item_id)
        self.windows = np.zeros((len(owners), window), dtype=np.int32)
        for row, words in enumerate(owners):
            self.windows[row, window - len(words) :] = words
        self.lengths = np.array([len(words) for words in owners], dtype=np.int64)
        self.owners = [sorted(ids) for ids in owners.values()]

    def hits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every occurrence in the documents' words."""
        nothing = np.empty(0, dtype=np.int64)
        if not len(self.windows):
            return nothing, nothing, nothing
        sizes = np.array([len(words) + 1 for words in texts], dtype=np.int64)  # a separator ends each
        firsts = np.cumsum(sizes) - sizes
        symbols = np.zeros(int(sizes.sum()), dtype=np.int32)
        for first, words in zip(firsts.tolist(), texts, strict=True):
            symbols[first : first + len(words)] = np.fromiter(
                map(self.vocabulary.get, words, repeat(0)), np.int32, len(words)
            )
        places = self._stretches(symbols)
        if not len(places):
            return nothing, nothing, nothing
        # neighbours in the index that are not neighbours in the text get a separator between them
        apart = np.flatnonzero(np.diff(places) > 1) + 1
        index = FMIndex(np.insert(symbols[places], apart, 0))
        places = np.insert(places, apart, -1)
        low, high = index.search(self.windows)
        counts = high - low
        found = np.flatnonzero(counts)
        windows = np.repeat(found, counts[found])
        rows = np.arange(len(windows)) - np.repeat(np.cumsum(counts[found]) - counts[found], counts[found])
        rows += low[windows]
        at = [places[index.locate(rows[i : i + LOCATED])] for i in range(0, len(rows), LOCATED)]
        at = np.concatenate(at) if at else nothing
        document = np.searchsorted(firsts, at, side="right") - 1
        return document, at - firsts[document], windows

    def _stretches(self, symbols: np.ndarray) -> np.ndarray:
        """Places of words in unbroken stretches of known words long enough for the shortest window."""
        known = np.concatenate([[False], symbols > 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.lengths.min()
        change = np.zeros(len(symbols) + 1, dtype=np.int8)
        change[starts[long]] = 1
        change[ends[long]] -= 1
        return np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, window: int) -> list[Block]:
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string")).dropna()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    if n == 1:
        return [Block([tuple(r) for r in items.collect()], window)]
    own = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    return [Block([(r.id, r.text) for r in own.filter(F.col("block") == k).collect()], window) for k in range(n)]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop: tuple[str, ...] = ()
) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (merged, in words) and ``items`` (ids as strings).

    ``benchmark`` has ``item_id`` and ``text``. Columns in ``drop`` are left out.
    """
    state = T.StructType().add("n_words", "long").add("spans", _SPANS).add("items", T.ArrayType(T.StringType()))
    blocks = _blocks(benchmark, window)
    out = docs.drop(*[n for n in state.names if n in docs.columns])
    for k, block in enumerate(blocks):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        before = [F.col("spans"), F.col("items")] if k else []
        out = with_columns_in_arrow(
            out,
            [out["text"].cast("string"), *before],
            state,
            lambda sent=sent: lambda columns: _pass(sent.value, columns),
            drop if k == len(blocks) - 1 else (),
        )
    return out


def _pass(block: Block, columns: list) -> list[list]:
    texts = [alnum_words(text.as_py() or "") for text in columns[0]]
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    if len(columns) > 1:
        for i, (old, ids) in enumerate(zip(columns[1], columns[2], strict=True)):
            spans[i] += [(s["start"], s["end"]) for s in old.as_py()]
            items[i].update(ids.as_py())
    documents, firsts, windows = block.hits(texts)
    ends = firsts + block.lengths[windows]
    for document, start, end, window in zip(
        documents.tolist(), firsts.tolist(), ends.tolist(), windows.tolist(), strict=True
    ):
        spans[document].append((start, end))
        items[document].update(block.owners[window])
    return [
        [len(words) for words in texts],
        [[{"start": s, "end": e} for s, e in merged(of)] for of in spans],
        [sorted(ids) for ids in items],
    ]


def judge(found: DataFrame, share: int = 20) -> DataFrame:
    """Counts, a digest of the items, and whether a document is contaminated: hit words are at least 1 / ``share``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : words[start][0]])
        at = words[end - 1][1]
    return "".join([*out, text[at:]])


def remove_passages(found: DataFrame) -> DataFrame:
    """The rows of ``find_passages`` with their spans cut from ``text``; rows without spans stay as they are."""
    text = T.StructType().add("text", "string")

    def worker():
        return lambda columns: [
            [
                t.as_py()
                if not len(s.as_py() or [])
                else without_spans(t.as_py(), [(x["start"], x["end"]) for x in s.as_py()])
                for t, s in zip(*columns, strict=True)
            ]
        ]

    return with_columns_in_arrow(found, [F.col("text").cast("string"), F.col("spans")], text, worker).select(
        *found.columns
    )
