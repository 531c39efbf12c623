"""Packing documents into windows of a fixed number of tokens by sum-of-squares placement.

Every document is tokenised, closed with id 0 and cut into whole windows; the rest is placed
into the partially filled window whose fill level makes the sum over levels of the squared
number of windows at that level smallest. Only the counts per level and the open windows are
held. A task packs the documents of its partition, so nothing is shuffled; it keeps at most
``max_open`` windows open (beyond that a document is cut to close the fullest one), and when
its documents end, the open windows are filled up from each other by cutting. At most one
window per task is left short.

Defined results: a null text is an empty one (id 0 alone); a null id is carried; repeated rows
are packed as rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
SEPARATOR = 0
#: The pattern that splits text before byte-pair merging; a fixed value of the public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A long text is encoded in slices of about this many characters.
SLICE = 1 << 20
#: White space as the pattern means it, in runs that are too long for its look-ahead.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(path: str) -> dict[bytes, int]:
    """Ids by bytes, from a byte-level BPE tokenizer file whose ids follow its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    # The public byte alphabet: printable bytes stand for themselves, others for code points from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    return {
        bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
    }


class Encoder:
    """Ids of a text without added tokens, as the tokenizer file gives them.

    A long text is encoded in slices. A single space with other characters on both sides
    always starts a token, so a text may be cut before one. Of a run of white space the pattern takes
    all but the last character before anything else, or all at the end of the text; a very long run
    is given to the byte-pair merging as just that piece.
    """

    def __init__(self, path: str):
        import tiktoken

        self._bpe = tiktoken.Encoding(
            "bytes", pat_str=PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={}
        )

    def ids(self, text: str) -> np.ndarray:
        parts, at = [], 0
        if len(text) >= 10_000:
            for run in _LONG_SPACE.finditer(text):
                end = run.end() if run.end() == len(text) else run.end() - 1
                parts.append(self._sliced(text[at : run.start()]))
                parts.append(np.array(self._bpe._encode_single_piece(text[run.start() : end]), dtype="<u4"))
                at = end
        rest = self._sliced(text[at:])
        return np.concatenate([*parts, rest]) if parts else rest

    def _sliced(self, text: str) -> np.ndarray:
        if len(text) <= 2 * SLICE:
            return np.array(self._bpe.encode_ordinary(text), dtype="<u4")
        parts, at = [], 0
        while at < len(text):
            end = self._cut(text, at + SLICE)
            parts.append(np.array(self._bpe.encode_ordinary(text[at:end]), dtype="<u4"))
            at = end
        return np.concatenate(parts)

    @staticmethod
    def _cut(text: str, at: int) -> int:
        """The next single space between other characters from ``at`` on, or the end."""
        while (at := text.find(" ", at)) >= 0:
            if at < len(text) - 1 and not text[at - 1].isspace() and not text[at + 1].isspace():
                return at
            at += 1
        return len(text)


class Tokenizer:
    """Ids of a text in which added tokens of the file stand for their own ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on what stands around them are not supported")
        self._added = {t["content"]: t["id"] for t in added if t["content"]}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self._added else None
        self._encoder = Encoder(path)

    def ids(self, text: str) -> np.ndarray:
        pieces = self._split.split(text) if self._split else [text]
        if len(pieces) == 1:
            return self._encoder.ids(text)
        # text and added tokens by turns
        return np.concatenate(
            [np.array([self._added[p]], dtype="<u4") if i % 2 else self._encoder.ids(p) for i, p in enumerate(pieces)]
        )


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens) into windows; closed windows are lists of pieces."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # open windows by fill level
        self.at_level: list[list[list[tuple]]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def _level_for(self, size: int) -> int:
        """The level to place ``size`` at; 0 is a new window."""
        levels = np.flatnonzero(self.count[1 : self.capacity - size + 1]) + 1
        if not len(levels):
            return 0
        # (n+1)^2 - n^2 at the new level and (n-1)^2 - n^2 at the old one; a full window leaves the array
        cost = 2 * (self.count[levels + size] - self.count[levels]) + 2 - (levels + size == self.capacity)
        best = len(levels) - 1 - int(np.argmin(cost[::-1]))
        return int(levels[best]) if cost[best] <= 2 * self.count[size] + 1 else 0

    def _put(self, level: int, piece: tuple) -> Iterator[list[tuple]]:
        if level:
            window = self.at_level[level].pop()
            self.count[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        level += len(piece[2])
        if level == self.capacity:
            yield window
        else:
            self.at_level[level].append(window)
            self.count[level] += 1
            self.open += 1

    def place(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            yield [(doc_id, start, ids[start : start + self.capacity], total)]
            start += self.capacity
        while start < total:
            level = self._level_for(total - start)
            end = total
            if not level and self.open >= self.max_open:
                level = int(np.flatnonzero(self.count)[-1])
                end = min(total, start + self.capacity - level)
            # a copy, so that an open window does not hold the ids of a whole long document
            yield from self._put(level, (doc_id, start, ids[start:end].copy(), total))
            start = end

    def finish(self) -> Iterator[list[tuple]]:
        """Close what is open: the emptiest windows are cut to fill the fullest ones."""
        left = [w for level in self.at_level for w in level]  # by fill, ascending
        while left:
            window = left.pop()
            room = self.capacity - sum(len(p[2]) for p in window)
            while room and left:
                doc_id, start, ids, total = left[0].pop()
                window.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    left[0].append((doc_id, start + room, ids[room:], total))
                if not left[0]:
                    left.pop(0)
                room -= min(room, len(ids))
            yield window


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, max_open: int = 512
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which window.

    ``tokenizer`` is a path every executor can read; its ids come from the vocabulary of that
    file. Windows that are not full are to be padded to ``capacity``.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = None, Packer(capacity, max_open)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, total in window:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            rows.clear()
            return batch

        for batch in batches:
            encoder = encoder or Tokenizer(path)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), np.array([SEPARATOR], dtype="<u4"))
                for window in packer.place(doc_id, ids):
                    emit(window)
                if len(rows) >= 20_000:
                    yield flush()
        for window in packer.finish():
            emit(window)
        if rows:
            yield flush()

    names = [c.split()[0] for c in PIECES.split(", ")]
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, PIECES)
