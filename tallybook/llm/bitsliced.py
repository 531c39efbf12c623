"""Exact top-k by inner product over a bit-sliced index.

Every component is quantised to an integer and stored as bit slices: one bitmap over the rows
of a chunk for each bit of each dimension. The scores of a query with all rows of a chunk are
themselves bit slices, made by adding the slices of its non-zero digits with bitmap
arithmetic (carry-save adders). Top rows are then taken from the most significant slice
downward; rows left on the boundary are equal in every slice, so the smallest ids are taken.

Queries are taken in blocks; every block meets every chunk, each chunk gives at most k rows per
query, and those are ranked per query. Chunks and blocks meet through a key of at most
``MAX_PARTS`` values, to which the blocks (k times smaller than the data) are copied.

Integers of any size are exact: vectors with one of ``WIDE`` or more are held in lots of their own,
as Python's integers. A score among the best that does not fit a long is an error.

Defined results: vectors that are null, empty or hold a null or non-finite component, and rows
without an id, take no part; vectors are compared only with vectors of as many components; rows with the query's id are its own and no
candidates; rows that repeat an id and vector are candidates of their own, and a repeated query is
answered once for each row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.tables import stored

SCALE = 256
#: From this size on integers are Python's, in lots of at most so many components.
WIDE, WIDE_COMPONENTS = 1 << 40, 1 << 19
#: Rows of a chunk and of a block of queries.
CHUNK, BLOCK = 1 << 16, 256
LONGEST = (1 << 63) - 1
MAX_PARTS = 1024


def _exact(value: float, scale: int) -> int:
    """The floor of ``value * scale``, which may be beyond the range of doubles."""
    scaled = value * scale
    return math.floor(scaled) if math.isfinite(scaled) else int(value) * scale


def quantised(ids: pa.Array, vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) of the rows that take part, by number of components; wide ones are objects."""
    kept = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
    ids, vectors = ids.filter(pa.array(kept)), vectors.filter(pa.array(kept))
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *vectors.value_lengths().to_pylist()])
    sizes, firsts, ids = np.diff(ends), ends[:-1], ids.to_numpy(zero_copy_only=False).astype(np.int64)
    for size in np.unique(sizes):
        if size:
            rows = np.flatnonzero(sizes == size)
            found = values[firsts[rows][:, None] + np.arange(size)]
            good = np.isfinite(found).all(axis=1)
            rows, found = rows[good], found[good]
            wide = (np.abs(found) >= WIDE // scale).any(axis=1)
            yield ids[rows[~wide]], np.floor(found[~wide] * scale).astype(np.int64)
            if wide.any():
                yield ids[rows[wide]], np.frompyfunc(lambda x: _exact(x, scale), 1, 1)(found[wide])


def _gathered(batches: Iterator[pa.RecordBatch], scale: int, most: int):
    """The rows of a task in lots of at most ``most`` rows of the same number and kind of components."""
    waiting: dict[tuple, tuple[list, list]] = {}
    all_rows = most
    for batch in batches:
        for ids, vectors in quantised(batch.column(0), batch.column(1), scale):
            key = vectors.shape[1], vectors.dtype == object
            most = min(all_rows, max(1, WIDE_COMPONENTS // vectors.shape[1])) if key[1] else all_rows
            for at in range(0, len(ids), most):
                i, v = waiting.setdefault(key, ([], []))
                i.append(ids[at : at + most])
                v.append(vectors[at : at + most])
                if sum(map(len, i)) >= most:
                    del waiting[key]
                    ids_, vectors_ = np.concatenate(i), np.concatenate(v)
                    yield ids_[:most], vectors_[:most]
                    if len(ids_) > most:
                        waiting[key] = ([ids_[most:]], [vectors_[most:]])
    for i, v in waiting.values():
        yield np.concatenate(i), np.concatenate(v)


def _table(rows: DataFrame, scale: int, most: int, layout) -> DataFrame:
    """One row per lot: number in its task, components, and the binary columns ``layout`` makes."""
    schema = "lot long, dim int, ids binary, bits int, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        for number, (ids, vectors) in enumerate(_gathered(batches, scale, most)):
            ids, bits, data = layout(ids, vectors)
            data = data if isinstance(data, bytes) else data.tobytes()
            row = [[first + number], [vectors.shape[1]], [ids.tobytes()], [bits], [data]]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=["lot", "dim", "ids", "bits", "data"]
            )

    return rows.mapInArrow(run, schema)


def _as_bytes(vectors: np.ndarray) -> tuple[int, bytes]:
    """Integers in 8 bytes each, or the number of bytes that objects need; and 0 or that number."""
    if vectors.dtype != object:
        return 0, vectors.astype("<i8").tobytes()
    size = int(np.abs(vectors).max()).bit_length() // 8 + 1
    return size, b"".join(x.to_bytes(size, "little", signed=True) for x in vectors.ravel())


def _from_bytes(size: int, data: bytes) -> np.ndarray:
    if not size:
        return np.frombuffer(data, dtype="<i8")
    found = [int.from_bytes(data[i : i + size], "little", signed=True) for i in range(0, len(data), size)]
    return np.array(found, dtype=object)


def sliced(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Rows by ascending id; slices [dimension, bit, word] of the components plus ``2 ** (bits - 1)``."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    bits = int(np.abs(vectors).max()).bit_length() + 1
    shifted = (vectors + (1 << (bits - 1))).T
    padded = np.zeros((vectors.shape[1], -(-len(ids) // 64) * 64), dtype=vectors.dtype)
    padded[:, : len(ids)] = shifted
    slices = [np.packbits((padded >> b) & 1 == 1, axis=1, bitorder="little").view("<u8") for b in range(bits)]
    return ids, bits, np.stack(slices, axis=1)


class Chunk:
    """The bit-sliced vectors of some rows."""

    def __init__(self, ids: np.ndarray, bits: int, slices: np.ndarray):
        self.ids, self.bits, self.slices = ids, bits, slices
        self.inverse = ~slices
        self.words = slices.shape[2]
        rows = np.zeros(self.words * 64, dtype=bool)
        rows[: len(ids)] = True
        self.rows = np.packbits(rows, bitorder="little").view("<u8")

    def score_slices(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of all scores, lowest first, of what the scores are above a constant; and the constant."""
        plus, minus = signed_digits(query)
        base = -(1 << (self.bits - 1)) * int(query.sum())
        levels: list[list[np.ndarray]] = []
        for j in range(max(int(plus.max()), int(minus.max())).bit_length()):
            added = [self.slices[d] for d in np.flatnonzero((plus >> j) & 1)]
            taken = np.flatnonzero((minus >> j) & 1)
            # minus u is its complement less the largest value
            base -= len(taken) * ((1 << self.bits) - 1) << j
            levels.append(added + [self.inverse[d] for d in taken])
        digits = _added(levels)  # digits[w][b] has weight 2 ** (w + b)
        # the sum over b: every bit of the components is a number whose slices are digits[:, b]
        by_weight: list[list[np.ndarray]] = [[] for _ in range(len(digits) + self.bits)]
        for w, block in enumerate(digits):
            if block is not None:
                for b in range(self.bits):
                    by_weight[w + b].append(block[b])
        nothing = np.zeros(self.words, dtype="<u8")
        return np.array([nothing if s is None else s for s in _added(by_weight)]).reshape(-1, self.words), base

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
        """(ids, scores) of the k best rows without those of id ``own``; ties go to the smaller id."""
        slices, base = self.score_slices(query)
        left = self.rows
        low, high = np.searchsorted(self.ids, [own, own + 1])
        if high > low:
            bits = np.ones(self.words * 64, dtype=bool)
            bits[low:high] = False
            left = left & np.packbits(bits, bitorder="little").view("<u8")
        sure = np.zeros_like(left)
        for piece in slices[::-1]:
            ones = left & piece
            n = int(np.bitwise_count(sure | ones).sum())
            if n > k:
                left = ones
            else:
                sure = sure | ones
                left = left & ~piece
                if n == k:
                    break
        found = _rows_of(sure)
        if len(found) < k:  # all that is left is equal; rows are in order of id
            found = np.concatenate([found, _rows_of(left)[: k - len(found)]])
        bits = (slices[:, found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)
        scores = [base + sum(int(b) << w for w, b in enumerate(column)) for column in bits.T.tolist()]
        return self.ids[found], scores


def _as_longs(scores: list[int]) -> pa.Array:
    """Null for a score below all longs: others may be better. One above them is among the best, and an error."""
    if scores and max(scores) > LONGEST:
        raise OverflowError(f"a score of {max(scores)} does not fit a long")
    return pa.array([s if s >= -LONGEST - 1 else None for s in scores], pa.int64())


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _added(levels: list[list[np.ndarray]]) -> list[np.ndarray | None]:
    """One bitmap per weight from any number of them, carried upward by full and half adders."""
    out: list[np.ndarray | None] = []
    levels = [list(level) for level in levels]
    at = 0
    while at < len(levels):
        level = levels[at]
        if len(level) > 1 and at + 1 == len(levels):
            levels.append([])
        while len(level) > 2:
            a, b, c = level.pop(), level.pop(), level.pop()
            ab = a ^ b
            levels[at + 1].append((a & b) | (ab & c))
            level.insert(0, ab ^ c)
        if len(level) == 2:
            a, b = level
            levels[at + 1].append(a & b)
            level = [a ^ b]
        out.append(level[0] if level else None)
        at += 1
    return out


def signed_digits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary digits 1 and -1 of integers, no two of them adjacent, as two bit masks."""
    size = np.abs(values)
    half = size >> 1
    both = size + half
    differ = half ^ both
    plus, minus = both & differ, half & differ
    below = values < 0
    return np.where(below, minus, plus), np.where(below, plus, minus)


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best candidates of each query row.

    ``queries`` is a condition on the rows of ``vectors``; all rows are candidates.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column), queries.alias("asked"))
    index = stored(_table(given.select("id", vector_column), scale, CHUNK, sliced), "bit-slices")
    blocks = stored(
        _table(given.filter("asked").select("id", vector_column), scale, BLOCK, lambda i, v: (i, *_as_bytes(v))), "queries"
    )
    parts = min(MAX_PARTS, max(1, index.count()))
    # chunks take turns over the parts; every block goes to each
    numbered = index.withColumn("part", F.pmod(F.xxhash64("lot"), F.lit(parts)))
    copied = blocks.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"),
        F.col("lot").alias("block"),
        F.col("dim"),
        F.col("ids").alias("query_ids"),
        F.col("bits").alias("size"),
        F.col("data").alias("queries"),
    )
    met = copied.join(numbered, ["part", "dim"]).select(
        "block", "dim", "query_ids", "size", "queries", "ids", "bits", "data"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "place", "query_id", "vec_id", "score"]
        for batch in batches:
            for row in range(batch.num_rows):
                block, dim, query_ids, size, queries_, ids, bits, data = (c[row].as_py() for c in batch.columns)
                ids = np.frombuffer(ids, dtype="<i8")
                words = -(-len(ids) // 64)
                chunk = Chunk(ids, bits, np.frombuffer(data, dtype="<u8").reshape(dim, bits, words))
                own = np.frombuffer(query_ids, dtype="<i8")
                asked = _from_bytes(size, queries_).reshape(-1, dim)
                best = [chunk.top(q, int(o), k) for q, o in zip(asked, own, strict=True)]
                sizes = [len(i) for i, _ in best]
                place = np.repeat(np.arange(len(own)), sizes)
                columns = [np.full(len(place), block), place, own[place], np.concatenate([i for i, _ in best])]
                scores = _as_longs([s for _, of in best for s in of])
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], scores], names=names)

    found = met.mapInArrow(run, "block long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "block", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    score = F.coalesce("score", F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
