"""Exact n-gram Jaccard join: documents whose sets of word shingles overlap enough are linked.

Jaccard distance is a metric, and the join runs through pivots, regions around them and
windows that the triangle inequality allows, level by level:

1. Documents with equal sets become one node.
2. First pivots are single shingles. A set of n shingles is at distance 1 - 1/n from each of its own
   and at 1 from all others, so a node's nearest pivots are its shingles; ties go by one
   global order, rare ones first. A node within the threshold of another misses at most a
   fixed share of its shingles, so it is enough to copy a node to its first few pivots: two
   nodes that are to be linked then meet at the first pivot they share.
3. Regions are split by size, the distance from the empty set: a linked pair differs in
   size by at most the threshold, so a node stands in its own size class and the next. Regions
   with the same members are joined once.
4. Inside a region, nodes are compared in a smaller space: the shingles of a node counted
   in 64 classes. There, distances are never larger than between the sets, so a pair too far apart
   there is not linked. Nodes that may be linked form groups.
5. Groups meet with their sets. Document pivots divide a group: a node belongs to its nearest
   pivot's region and, if another pivot is farther by at most twice the threshold, to that one's
   as well; by the triangle inequality no linked pair is separated. Regions are divided again
   until they are small or stop shrinking, and are then joined exactly by a matrix product.

Regions and groups of many nodes are cut into blocks, and pairs of blocks are joined as cells of
bounded size, so that no group has to fit one task.

A cell gives at most as many links as it has nodes, not its pairs. The links connect the same nodes as all links would; their
components are found by contraction.

The global order counts shingles over all documents in a table of fixed size; a shared
entry only makes a shingle look more frequent, which costs time and changes no result.

Defined results: null and empty texts, and texts of white space, have 0 shingles and are a
component of their own; equal texts and repeated rows share a component; a null id is carried,
never is a component's name, and its component is null if no member has an id; ids below
2 ** 62 in size are expected; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tallybook.llm.components import components
from tallybook.llm.shingles import shingle_sets
from tallybook.llm.tables import stored

#: Numbers of counters (as powers of 2) for the order of shingles, and of marks for pivots and nodes that take part: these
#: at least, ``MARKS_EACH`` for each of them, and 64 MB at most.
ORDER_BITS, MARK_BITS, MARKS_EACH, MOST_MARK_BITS = 21, 23, 16, 29
#: Pivots are looked for by their highest bits: so many for the bucket they travel in, and so many within it.
BUCKET_BITS, START_BITS = 12, 31
#: Counters travel in rows of this many; at most ``FAN_IN`` rows are added up by one task at a time.
_ROW, FAN_IN = 1 << 16, 64
#: Nodes in a block of a region; nodes, and bytes of sets, in a block of a group.
REGION_NODES, GROUP_NODES, GROUP_BYTES = 1024, 512, 16 << 20
#: Classes of shingles in the smaller space, and the highest count that is stored in 16 bits.
CLASSES, _MOST = 64, (1 << 16) - 1
#: Document pivots of a region, and nodes that are joined without dividing them.
PIVOTS, FEW = 8, 96
#: Columns of a matrix product.
_WIDE = 4096


class Threshold:
    """A similarity of at least ``over / under``, decided in integers."""

    def __init__(self, over: int, under: int):
        if not 0 < over < under:
            raise ValueError("the similarity must lie between 0 and 1")
        self.over, self.under = over, under

    def linked(self, shared, a, b):
        return self.under * shared >= self.over * (a + b - shared)

    def window(self, n: int) -> int:
        """Pivots a node is copied to: it can miss the rest of its shingles and still be linked to a larger node."""
        return n - -(-self.over * n // self.under) + 1

    def core(self, n: int) -> int:
        """Of these, the ones at which a node meets nodes that are not smaller."""
        return n - -(-2 * self.over * n // (self.over + self.under)) + 1

    @property
    def distance(self) -> float:
        return 1 - self.over / self.under


def _arrow_map(df: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[list]]) -> DataFrame:
    """``work`` gives lists of columns; they become batches of ``schema``."""
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, fields)


class Counters:
    """Counts of 64-bit numbers by their highest bits."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.counts = np.zeros(1 << bits, dtype=np.int64)

    def add(self, numbers: np.ndarray) -> None:
        np.add.at(self.counts, (numbers >> self.shift).astype(np.int64), 1)

    def rows(self) -> list[bytes]:
        """Counts up to 255, in rows."""
        small = np.minimum(self.counts, 255).astype(np.uint8)
        return [small[i : i + _ROW].tobytes() for i in range(0, len(small), _ROW)]


def _sum_of(rows) -> np.ndarray:
    """Rows of counters added up; they hold bytes as tasks wrote them, and longer numbers from then on."""
    kinds = {_ROW: np.uint8, 4 * _ROW: "<i4"}
    return sum(np.frombuffer(c, dtype=kinds[len(c)]).astype("<i4") for c in rows)


def _ranks_of(counts: np.ndarray) -> np.ndarray:
    """Frequencies on a scale of one byte."""
    return np.minimum(255, 8 * np.log2(1 + counts)).astype(np.uint8)


def _set_bits(bits: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bits, places >> 3, np.uint8(128) >> (places & 7).astype(np.uint8))


def _row_of_marks(bits: np.ndarray) -> bytes:
    """A row of marks, or the places of the marks that are set if they are shorter."""
    places = np.flatnonzero(np.unpackbits(bits)).astype("<u2")
    return min(bits.tobytes(), places.tobytes(), key=len)


def _any_of(rows) -> np.ndarray:
    """Rows of marks put together, eight in a byte."""
    found = np.zeros(_ROW // 8, dtype=np.uint8)
    for c in rows:
        if len(c) == len(found):
            found |= np.frombuffer(c, dtype=np.uint8)
        else:
            _set_bits(found, np.frombuffer(c, dtype="<u2").astype(np.int64))
    return found


def _put_together(rows: DataFrame, parts: int, merge, finish, out: np.ndarray) -> np.ndarray:
    """Rows (``row``, ``part``, ``counts``) of all tasks merged into ``out``, in steps of bounded width.

    The tasks ``finish`` the merged rows, so the driver gets a byte or a bit for each place.
    """

    def step(last: Callable[[np.ndarray], np.ndarray]):
        return lambda pdf: pdf.head(1).assign(counts=[last(merge(pdf["counts"])).tobytes()])

    schema = "row int, part long, counts binary"
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        wider = rows.withColumn("part", F.expr(f"part div {FAN_IN}"))
        rows = wider.groupBy("row", "part").applyInPandas(step(lambda merged: merged), schema)
    for r in rows.groupBy("row").applyInPandas(step(finish), schema).toLocalIterator():
        piece = np.frombuffer(r["counts"], dtype=np.uint8)
        out[r["row"] * len(piece) : (r["row"] + 1) * len(piece)] = piece
    return out


def _key(numbers: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    digest = np.frombuffer(xxhash.xxh3_128_digest(numbers.tobytes()), dtype="<i8")
    return int(digest[0]), int(digest[1])


class Nodes:
    """Sets of shingles of ``width`` words, and their names: the first half of the key, or a mix of both halves where two sets share it."""

    def __init__(self, shared: list[int], width: int):
        self.shared, self.width = frozenset(shared), width

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        return shingle_sets(texts, self.width)

    def of(self, key: tuple[int, int]) -> int:
        return key[0] if key[0] not in self.shared else key[0] ^ key[1]


def _shapes(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document (``doc_id``, ``n``, ``k1``, ``k2``), and rows of counters for each task."""

    def work(batches):
        counters = Counters(ORDER_BITS)
        for batch in batches:
            ns, keys = [], []
            for numbers in shingle_sets(batch.column(1), width):
                ns.append(len(numbers))
                keys.append(_key(numbers) if len(numbers) else (None, None))
                counters.add(numbers)
            nothing = [None] * len(ns)
            yield [batch.column(0), ns, [k[0] for k in keys], [k[1] for k in keys], nothing, nothing, nothing]
        rows = counters.rows()
        nothing, part = [None] * len(rows), [TaskContext.get().partitionId()] * len(rows)
        yield [nothing, nothing, nothing, nothing, list(range(len(rows))), part, rows]

    return _arrow_map(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        "doc_id long, n int, k1 long, k2 long, row int, part long, counts binary",
        work,
    )


def _once_per_task(docs: DataFrame, nodes: Nodes, schema: str, start, each, end) -> DataFrame:
    """Map over the distinct sets of each task: ``each(state, node, doc_id, numbers)``; ``end(state)`` gives columns.

    ``each`` says whether the set is done with; another row with the same set may be asked otherwise.
    """

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            state = start()
            for doc_id, numbers in zip(batch.column(0).to_pylist(), nodes.sets(batch.column(1)), strict=True):
                if len(numbers) and (node := nodes.of(_key(numbers))) not in seen:
                    if each(state, node, doc_id, numbers):
                        seen.add(node)
            yield end(state)

    return _arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, work)


def _first_pivots(ranks: np.ndarray, at_least: Threshold, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's first pivots in the global order, and which of them are its core."""
    shift, low = np.uint64(64 - ORDER_BITS), np.uint64(8)
    # rank first, then the number itself; equal keys keep the order of numbers
    order = ranks[(numbers >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56) | numbers >> low
    first = numbers[np.argsort(order, kind="stable")[: at_least.window(len(numbers))]]
    return first, np.arange(len(first)) < at_least.core(len(numbers))


def _ends_of_runs(starts: np.ndarray) -> np.ndarray:
    """Of sorted numbers ``2 * start + core``, the first and the last one of each start."""
    changes = np.flatnonzero(np.diff(starts >> 1)) + 1
    return starts[np.unique(np.concatenate([[0], changes, changes - 1, [len(starts) - 1]]))] if len(starts) else starts


def _shared_pivots(docs: DataFrame, nodes: Nodes, ranks, at_least: Threshold) -> DataFrame:
    """(``start``): highest bits of pivots, the others being 0, that have several nodes, one of them in its core.

    Pivots travel as 32 bits each, sorted, in buckets. Two pivots with the same highest bits may be taken for one,
    which the regions made of them settle.
    """
    below = np.uint64(64 - BUCKET_BITS - START_BITS)

    def end(state):
        starts = np.concatenate([(first >> below) << np.uint64(1) | core.astype(np.uint64) for first, core in state] or [np.empty(0, np.uint64)])
        starts = _ends_of_runs(np.sort(starts))
        buckets = (starts >> np.uint64(START_BITS + 1)).astype(np.int64)
        within = (starts & np.uint64((1 << START_BITS + 1) - 1)).astype("<u4")
        found, at = np.unique(buckets, return_index=True)
        return [found.astype(np.int32), [piece.tobytes() for piece in np.split(within, at[1:])] if len(found) else []]

    def each(state, node, doc_id, numbers):
        state.append(_first_pivots(ranks.value, at_least, numbers))
        return True

    def find(table: pa.Table) -> pa.Table:
        starts = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u4") for x in table.column("starts")]))
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(starts >> 1)) + 1, [len(starts)]])
        # of equal starts the one in a core is the last
        more = (np.diff(firsts) > 1) & (starts[firsts[1:] - 1] & 1 > 0)
        high = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(START_BITS)
        shared = (high | (starts[firsts[:-1][more]] >> 1).astype(np.uint64)) << below
        return pa.table([pa.array(shared.view("<i8"))], names=["start"])

    buckets = _once_per_task(docs, nodes, "bucket int, starts binary", list, each, end)
    return buckets.groupBy("bucket").applyInArrow(find, "start long")


def _spread(pivots: np.ndarray) -> np.ndarray:
    """Numbers to mark the starts of pivots by; pivots themselves lie closer where numbers are small, as these come first."""
    below = np.uint64(64 - BUCKET_BITS - START_BITS)
    return (pivots >> below) * np.uint64(0x9E3779B97F4A7C15)


def _entries(docs: DataFrame, nodes: Nodes, ranks, at_least: Threshold, marks) -> DataFrame:
    """(``pivot``, ``node``, ``n``, ``core``): each node at its first pivots in the global order whose mark is set."""

    def each(state, node, doc_id, numbers):
        first, core = _first_pivots(ranks.value, at_least, numbers)
        marked = _marked(marks.value, _spread(first))
        state.append((first[marked], core[marked], node, len(numbers)))
        return True

    def end(state):
        sizes = [len(s[0]) for s in state]
        first = np.concatenate([s[0] for s in state]).view("<i8") if state else []
        core = np.concatenate([s[1] for s in state]) if state else []
        spread = [np.repeat(np.array([s[k] for s in state], dtype=np.int64), sizes) for k in (2, 3)]
        return [first, spread[0], spread[1].astype(np.int32), core]

    return _once_per_task(docs, nodes, "pivot long, node long, n int, core boolean", list, each, end)


def _marks(rows: DataFrame, numbers: Callable[[list[np.ndarray]], np.ndarray]):
    """A broadcast bit for each value of the highest bits of the 64-bit numbers made of the columns of ``rows``.

    The bits follow the number of different rows, so that few others have their mark set. ``_marked`` reads them.
    """
    different = rows.agg(F.approx_count_distinct(F.xxhash64(*rows.columns))).first()[0]
    n_bits = min(MOST_MARK_BITS, max(MARK_BITS, (MARKS_EACH * different).bit_length()))

    def mark(batches):
        found = np.zeros((1 << n_bits) // 8, dtype=np.uint8)
        for batch in batches:
            made = numbers([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])
            _set_bits(found, (made >> np.uint64(64 - n_bits)).astype(np.int64))
        pieces = found.reshape(-1, _ROW // 8)
        for some in np.array_split(np.flatnonzero(pieces.any(axis=1)), -(-len(pieces) // 256)):
            yield [some.astype(np.int32), [TaskContext.get().partitionId()] * len(some), [_row_of_marks(pieces[i]) for i in some]]

    marked = stored(_arrow_map(rows, "row int, part long, counts binary", mark), "marks")
    parts = max(1, rows.rdd.getNumPartitions())
    bits = np.zeros((1 << n_bits) // 8, dtype=np.uint8)
    return rows.sparkSession.sparkContext.broadcast(_put_together(marked, parts, _any_of, lambda merged: merged, bits))


def _marked(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of the 64-bit numbers have their mark set."""
    places = numbers >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[(places >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (places & np.uint64(7)).astype(np.uint8))) & 1 > 0


def _regions(docs: DataFrame, nodes: Nodes, ranks, at_least: Threshold) -> DataFrame:
    """Members of regions with more than one node: (``pivot``, ``size``, ``node``, ``n``)."""
    shared = (F.count("*") > 1) & F.max("core")
    pivots = stored(_shared_pivots(docs, nodes, ranks, at_least), "pivots")
    marks = _marks(pivots, lambda columns: _spread(columns[0]))
    start = F.col("pivot").bitwiseAND(F.lit(-1 << 64 - BUCKET_BITS - START_BITS))
    entries = _entries(docs, nodes, ranks, at_least, marks).withColumn("start", start).join(pivots.hint("merge"), "start")
    # grouped as they were laid out for the join
    met = entries.groupBy("start", "pivot", "node").agg(F.max("n").alias("n"), F.max("core").alias("core")).drop("start")
    # a little wide, so that rounding never puts a pair that fits more than one class apart
    step = math.log(at_least.under / at_least.over) * (1 + 1e-9)
    own = F.floor(F.log("n") / step).cast("int")
    met = stored(met.withColumn("size", F.explode(F.array(own, own + 1))), "met")
    alike = ("members", "one", "other")
    regions = met.groupBy("pivot", "size").agg(
        shared.alias("more"),
        F.count("*").alias("members"),
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("other"),
    )
    kept = regions.filter("more").groupBy(*alike).agg(F.min(F.struct("pivot", "size")).alias("first"))
    kept = stored(kept.select("first.pivot", "first.size"), "regions")
    return stored(met.join(kept.hint("merge"), ["pivot", "size"]).drop("core"), "members")


def _in_cells(rows: DataFrame, key: list[str], blocks) -> DataFrame:
    """``rows`` copied to the cells ``i``, ``j`` of their group: the pairs of blocks that a row's block is in.

    ``blocks`` is the number of blocks as an aggregate over a group.
    """
    counted = stored(rows.groupBy(*key).agg(F.ceil(blocks).cast("long").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.struct(F.least(other, own).alias("i"), F.greatest(other, own).alias("j")),
    )
    return rows.join(counted, key).select(*rows.columns, F.inline(pairs))


def _classes(numbers: np.ndarray) -> bytes:
    """How many shingles fall into each class, in 16 bits each, or in 32 if one would not fit."""
    counts = np.bincount((numbers & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
    return counts.astype("<u2" if counts.max() <= _MOST else "<u4").tobytes()


def _counts_of(rows: list[bytes]) -> np.ndarray:
    """Counts by class, a row for each node."""
    out = np.empty((len(rows), CLASSES), dtype=np.int64)
    for own, stored_counts in zip(out, rows, strict=True):
        own[:] = np.frombuffer(stored_counts, dtype="<u2" if len(stored_counts) == 2 * CLASSES else "<u4")
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix of links connects."""
    out, left = [], np.ones(len(linked), dtype=bool)
    for first in range(len(linked)):
        if left[first]:
            left[first] = False
            reached = [first]
            while reached:
                i = reached.pop()
                more = np.flatnonzero(linked[i] & left)
                left[more] = False
                out += [(i, j) for j in more.tolist()]
                reached += more.tolist()
    return out


def _may_be_linked(sizes: np.ndarray, counts: np.ndarray, at_least: Threshold) -> np.ndarray:
    """Pairs that the counts by class do not tell apart: the shared shingles are at most the sum of smaller counts."""
    shared = np.zeros((len(sizes), len(sizes)), dtype=np.int64)
    for column in counts.T:
        shared += np.minimum(column[:, None], column[None, :])
    smaller = np.minimum(sizes[:, None], sizes[None, :])
    return at_least.linked(np.minimum(shared, smaller), sizes[:, None], sizes[None, :])


def _as_links(nodes: np.ndarray, places: list[tuple[int, int]]) -> pa.Table:
    ends = [pa.array([int(nodes[p[k]]) for p in places], pa.int64()) for k in (0, 1)]
    return pa.table(ends, names=["a", "b"])


def _groups(docs: DataFrame, nodes: Nodes, members: DataFrame, at_least: Threshold) -> DataFrame:
    """(``node``, ``root``) of the nodes that may be linked to another one."""
    marks = _marks(members.select("node"), lambda columns: columns[0])

    def each(state, node, doc_id, numbers):
        if _marked(marks.value, np.uint64(node & (1 << 64) - 1)):
            state.append((node, _classes(numbers)))
        return True

    found = _once_per_task(docs, nodes, "node long, counts binary", list, each, lambda s: [[x[0] for x in s], [x[1] for x in s]])
    counted = found.groupBy("node").agg(F.first("counts").alias("counts"))
    cells = _in_cells(members, ["pivot", "size"], F.count("*") / float(REGION_NODES))

    def join_cell(table: pa.Table) -> pa.Table:
        counts = _counts_of(table.column("counts").to_pylist())
        sizes = table.column("n").to_numpy().astype(np.int64)
        linked = _may_be_linked(sizes, counts, at_least)
        return _as_links(table.column("node").to_numpy(), _forest(linked))

    with_counts = cells.join(stored(counted, "counts").hint("merge"), "node")
    links = with_counts.groupBy("pivot", "size", "i", "j").applyInArrow(join_cell, "a long, b long")
    return components(links)


class Cell:
    """Sets with numbered shingles, of which only those that two sets share matter."""

    def __init__(self, sets: list[np.ndarray], at_least: Threshold):
        self.at_least = at_least
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        everything, place = np.unique(np.concatenate(sets), return_inverse=True)
        frequent = np.bincount(place, minlength=len(everything)) > 1
        kept = frequent[place]
        self.columns = (np.cumsum(frequent) - 1)[place[kept]]
        counts = np.bincount(np.repeat(np.arange(len(sets)), self.sizes)[kept], minlength=len(sets))
        self.ends = np.concatenate([[0], np.cumsum(counts)])
        self.width = int(frequent.sum())

    def _of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows``, column) of their shingles."""
        pieces = [self.columns[self.ends[r] : self.ends[r + 1]] for r in rows.tolist()]
        return np.repeat(np.arange(len(rows)), [len(p) for p in pieces]), np.concatenate(pieces)

    def shared_with(self, pivot: int, at: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """Shingles that rows, given by ``_of``, share with one set."""
        own = np.zeros(self.width, dtype=bool)
        own[self.columns[self.ends[pivot] : self.ends[pivot + 1]]] = True
        return np.bincount(at[own[columns]], minlength=n)

    def product(self, rows: np.ndarray) -> np.ndarray:
        """Which of these sets are linked, by a matrix product over the shingles they share."""
        at, columns = self._of(rows)
        _, columns = np.unique(columns, return_inverse=True)
        order = np.argsort(columns, kind="stable")
        at, columns = at[order], columns[order]
        shared = np.zeros((len(rows), len(rows)), dtype=np.float32)
        width = int(columns[-1]) + 1 if len(columns) else 0
        for first in range(0, width, _WIDE):
            a, b = np.searchsorted(columns, [first, first + _WIDE])
            present = np.zeros((len(rows), min(_WIDE, width - first)), dtype=np.float32)
            present[at[a:b], columns[a:b] - first] = 1
            shared += present @ present.T
        sizes = self.sizes[rows]
        return self.at_least.linked(shared.astype(np.int64), sizes[:, None], sizes[None, :])

    def regions(self, rows: np.ndarray) -> list[np.ndarray]:
        """Regions around document pivots, with the nodes that windows copy into them; together they keep every link."""
        pivots = rows[np.linspace(0, len(rows) - 1, PIVOTS).astype(int)]
        at, columns = self._of(rows)
        sizes = self.sizes[rows]
        distance = np.empty((len(rows), len(pivots)))
        for k, pivot in enumerate(pivots.tolist()):
            shared = self.shared_with(pivot, at, columns, len(rows))
            distance[:, k] = 1 - shared / (sizes + self.sizes[pivot] - shared)
        # sets keep shingles no other set has, so a pivot is measured against itself apart
        distance[rows[:, None] == pivots[None, :]] = 0
        nearest = distance.min(axis=1)
        inside = distance <= (nearest + 2 * self.at_least.distance + 1e-9)[:, None]
        own = distance.argmin(axis=1)
        return [rows[inside[:, k]] for k in range(len(pivots)) if (own == k).any()]

    def links(self) -> list[tuple[int, int]]:
        """Places of links that connect all linked sets."""
        found: list[tuple[int, int]] = []
        waiting = [np.arange(len(self.sizes))]
        while waiting:
            rows = waiting.pop()
            parts = self.regions(rows) if len(rows) > FEW else []
            sizes = [len(part) for part in parts]
            if parts and max(sizes) <= 0.7 * len(rows) and sum(sizes) <= 2 * len(rows):
                waiting += parts
            else:  # few, or not divided by these pivots
                found += [(int(rows[i]), int(rows[j])) for i, j in _forest(self.product(rows))]
        return found


def _joined(docs: DataFrame, nodes: Nodes, grouped: DataFrame, at_least: Threshold) -> DataFrame:
    """Links (``a``, ``b``) inside groups (rows ``node``, ``root``, ``least``, ``n``)."""

    def both(columns: list[np.ndarray]) -> np.ndarray:
        return columns[0] ^ (columns[1] * np.uint64(0x9E3779B97F4A7C15))

    # of the rows with a set, the one with the smallest id gives the set
    marks = _marks(grouped.select("node", F.coalesce("least", F.lit(0))), both)

    def each(state, node, doc_id, numbers):
        if _marked(marks.value, np.uint64((node ^ (doc_id or 0) * 0x9E3779B97F4A7C15) & (1 << 64) - 1)):
            state.append((node, numbers.tobytes()))
            return True
        return False

    sets = _once_per_task(docs, nodes, "node long, numbers binary", list, each, lambda s: [[x[0] for x in s], [x[1] for x in s]])
    blocks = F.greatest(F.count("*") / float(GROUP_NODES), F.sum("n") * 8 / float(GROUP_BYTES))
    cells = stored(_in_cells(grouped.select("node", "root", "n"), ["root"], blocks).drop("n"), "cells")

    def join_cell(table: pa.Table) -> pa.Table:
        found = dict(zip(table.column("node").to_pylist(), table.column("numbers"), strict=True))  # each node once
        sets_ = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in found.values()]
        return _as_links(np.array(list(found), dtype=np.int64), Cell(sets_, at_least).links())

    with_sets = sets.join(cells.hint("merge"), "node")
    return with_sets.groupBy("root", "i", "j").applyInArrow(join_cell, "a long, b long")


def named_nodes(docs: DataFrame, at_least: Threshold, width: int = 3) -> tuple[DataFrame, DataFrame, Nodes]:
    """(rows ``doc_id``, ``n``, ``node``; rows ``node``, ``component_id``, ``rows`` of the component; the names of sets)."""
    spark = docs.sparkSession
    shapes = stored(_shapes(docs, width), "shapes")
    parts = max(1, docs.rdd.getNumPartitions())
    counters = shapes.filter("counts IS NOT NULL").select("row", "part", "counts")
    order = np.zeros(1 << ORDER_BITS, dtype=np.uint8)
    ranks = spark.sparkContext.broadcast(_put_together(counters, parts, _sum_of, _ranks_of, order))

    rows = shapes.filter("n IS NOT NULL").drop("row", "part", "counts")
    some = rows.filter("n > 0")
    # halves of keys that several sets share: next to none, whatever the size of the corpus
    twice = some.groupBy("k1").agg(F.min("k2").alias("a"), F.max("k2").alias("b")).filter("a <> b").select("k1")
    nodes = Nodes([r["k1"] for r in twice.collect()], width)
    k1 = F.col("k1")
    node = F.when(k1.isin(sorted(nodes.shared)), k1.bitwiseXOR(F.col("k2"))).otherwise(k1) if nodes.shared else k1
    named = stored(
        some.groupBy(node.alias("node")).agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count("*").alias("rows")),
        "named",
    )

    members = _regions(docs, nodes, ranks, at_least)
    grouped = stored(_groups(docs, nodes, members, at_least).join(named, "node"), "grouped")
    roots = components(_joined(docs, nodes, grouped, at_least))
    together = stored(named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    ids = together.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("rows"))
    answer = stored(together.drop("rows").join(ids, "root").select("node", "component_id", "rows"), "components")
    return rows.select("doc_id", "n", node.alias("node")), answer, nodes


def join(docs: DataFrame, over: int = 90, under: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Documents are linked if their similarity is at least ``over / under``; the component's id is
    the smallest document id that links reach.
    """
    rows, answer, _ = named_nodes(docs, Threshold(over, under))
    alone = rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = rows.filter("n > 0").join(answer, "node")
    return linked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").union(alone)


def keep_one(docs: DataFrame, over: int = 90, under: int = 100, width: int = 3) -> DataFrame:
    """``docs`` with one row of each component, the one that names it; rows without shingles all stay.

    Shingles are of ``width`` words.

    Where no row of a component has an id, one row of each distinct set stays.
    """
    _, answer, nodes = named_nodes(docs.select("doc_id", "text"), Threshold(over, under), width)
    # a component of one row needs no judging, so its text is not moved; marks may take some for others, which are judged
    crowded = answer.filter("rows > 1").drop("rows")
    marks = _marks(crowded.select("node"), lambda columns: columns[0])

    given = docs.select(F.col("text").cast("string").alias("__text"), *[docs[f"`{c}`"] for c in docs.columns])
    schema = StructType([StructField("__node", LongType()), *docs.schema.fields])

    def rows_that(are_crowded: bool):
        def run(batches):
            for batch in batches:
                found = pa.array([nodes.of(_key(s)) if len(s) else None for s in nodes.sets(batch.column(0))], pa.int64())
                sets = found.is_valid().to_numpy(zero_copy_only=False)
                taken = sets & _marked(marks.value, found.fill_null(0).to_numpy().view(np.uint64))
                rows = pa.RecordBatch.from_arrays([found, *batch.columns[1:]], names=schema.names)
                yield rows.filter(pa.array(taken if are_crowded else ~taken))

        return given.mapInArrow(run, schema)

    crowded = crowded.withColumnsRenamed({"node": "__own", "component_id": "__component"})
    judged = rows_that(True).join(crowded, F.col("__node") == F.col("__own"), "left")
    alone = F.col("__own").isNull()
    chosen = judged.filter(alone | F.col("doc_id").eqNullSafe(F.col("__component")))
    # repeated rows are dropped by a key the join is not laid out by: a set that a third of all rows
    # share is then split between tasks of the join, and dropped before it is shuffled again
    one = chosen.withColumn("__node", F.col("__node").cast("string").cast("long")).dropDuplicates(["__node"])
    return rows_that(False).select(*docs.columns).union(one.select(*docs.columns))
