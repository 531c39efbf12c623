import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybook.llm import components, jaccard, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def brute(rows, over=90, under=100):
    """Components over all pairs; returns (doc_id, n, component), for rows whose ids are unique."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and under * len(a & b) >= over * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(docs, **options):
    return sorted((tuple(r) for r in jaccard.join(docs, **options).collect()), key=str)


def near_copies(seed, n=60, length=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, length))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = words[: rng.randint(1, len(words))]
        rows.append((i * 7 % 1009, " ".join(words)))
    return rows


EDGES = [
    (2001, None), (2002, ""), (2003, " \n\t"), (2004, "One"), (2005, "one"), (2006, "one two"), (2007, "ONE\ttwo"),
    (2008, "one two three"), (None, "one two three"), (None, "lonely words stand here"), (2009, "x " * 4000), (2010, "y" * 700_000),
    (2011, "x " * 5000), (2012, "É é é"), (2013, "é é é"), (2014, "a b c d"),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, documents, seed):
    rows = [*near_copies(seed), *EDGES]
    assert run(documents(rows)) == brute(rows)


def test_another_threshold_and_small_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION_NODES", 3)
    monkeypatch.setattr(jaccard, "GROUP_NODES", 4)
    monkeypatch.setattr(jaccard, "FAN_IN", 2)
    rows = near_copies(3, n=80, length=30)
    assert run(documents(rows, 5), over=6, under=10) == brute(rows, 6, 10)


def test_keys_that_share_a_half(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "_key", lambda numbers: (int(numbers[0]) % 3, int(numbers.sum()) % (1 << 62)))
    rows = near_copies(4, n=30)
    assert run(documents(rows)) == brute(rows)


def test_repeated_rows_and_empty_tables(spark, documents):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e")]
    assert run(documents(rows)) == [(1, 3, 1), (1, 3, 1), (2, 3, 1)]
    assert run(documents([])) == []


def test_one_of_each_component_stays(spark, documents):
    rows = [*near_copies(5), *EDGES]
    kept = jaccard.keep_one(documents(rows))
    expected = [d for d, n, c in brute(rows) if n == 0 or (d == c and d is not None)]
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(expected)
    assert got.count(None) == 1  # the row without an id that is like no row with one
    assert kept.columns == documents(rows).columns


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \té\n", max_size=40)), max_size=12), st.integers(2, 30))
def test_shingle_sets(texts, width):
    kept, shingles.SLICE = shingles.SLICE, width
    try:
        found = list(shingles.shingle_sets(pa.array(texts, pa.string())))
    finally:
        shingles.SLICE = kept
    expected = [shingle_set(t) for t in texts]
    assert [len(f) for f in found] == [len(e) for e in expected]
    for i, a in enumerate(expected):
        for j, b in enumerate(expected):
            assert len(np.intersect1d(found[i], found[j])) == len(a & b)


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 10**6), st.sampled_from([(90, 100), (8, 10), (97, 100)]))
def test_cell_finds_what_all_pairs_find(seed, ratio):
    """Copies of a few texts with more and fewer changes, so that pivots divide them."""
    rng = np.random.default_rng(seed)
    bases = [np.unique(rng.integers(0, 5000, 60)).astype(np.uint64) for _ in range(5)]
    sets = []
    for _ in range(130):
        s = bases[rng.integers(5)].copy()
        s[: rng.integers(0, 14)] += np.uint64(rng.integers(0, 6000))
        sets.append(np.unique(s))
    at_least = jaccard.Threshold(*ratio)
    kept, jaccard.FEW = jaccard.FEW, 10
    try:
        links = jaccard.Cell(sets, at_least).links()
    finally:
        jaccard.FEW = kept
    root, expected = list(range(130)), list(range(130))

    def find(r, i):
        while r[i] != i:
            i = r[i]
        return i

    for a, b in links:
        assert at_least.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
        root[max(find(root, a), find(root, b))] = min(find(root, a), find(root, b))
    for a in range(130):
        for b in range(a):
            if at_least.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                expected[max(find(expected, a), find(expected, b))] = min(find(expected, a), find(expected, b))
    assert [find(root, i) for i in range(130)] == [find(expected, i) for i in range(130)]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (300, 200), (7, 7), (500, 500), (60, 2)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert len(found) == len(roots)
    assert roots == {**{i: 0 for i in range(41)}, 60: 0, 100: 100, 200: 100, 300: 100}


@given(st.integers(1, 300), st.integers(1, 300), st.integers(0, 300))
def test_windows_hold_every_linked_pair(a, b, shared):
    """Nodes of sizes a <= b that share enough meet at the first pivot they share, wherever the rest stands."""
    a, b = min(a, b), max(a, b)
    shared = min(shared, a)
    at_least = jaccard.Threshold(90, 100)
    if at_least.linked(shared, a, b):
        assert 100 * a >= 90 * b
        assert a - shared + 1 <= at_least.core(a)
        assert b - shared + 1 <= at_least.window(b)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_shingles_of_another_width(width):
    texts = ["a b c d e f a b c d e", "A b c d e", "b c d e f", "a b c d", "a b c", "a", "", None, "x " * 4000]
    expected = []
    for text in texts:
        words = (text or "").lower().split()
        expected.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    found = list(shingles.shingle_sets(pa.array(texts, pa.string()), width))
    assert [len(f) for f in found] == [len(e) for e in expected]
    for a, x in zip(found, expected):
        assert [len(np.intersect1d(a, b)) for b in found] == [len(x & y) for y in expected]


@pytest.mark.parametrize("most", [3, 150, 65_535])
def test_counts_beyond_16_bits_tell_no_linked_pair_apart(monkeypatch, most):
    monkeypatch.setattr(jaccard, "_MOST", most)
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 10_000).astype(np.uint64))
    sets = [a, a[50:], a[:30], rng.integers(0, 1 << 63, 10_000).astype(np.uint64)]
    counts = jaccard._counts_of([jaccard._classes(s) for s in sets])
    assert counts.sum(axis=1).tolist() == [len(s) for s in sets]
    may = jaccard._may_be_linked(np.array([len(s) for s in sets]), counts, jaccard.Threshold(90, 100))
    assert may[0, 1] and not may[0, 2]


def test_a_class_of_over_65535_shingles():
    """More shingles than 64 classes of 16 bits can count, and one in a hundred changed."""
    a = np.arange(4_700_000, dtype=np.uint64)
    b = a + np.uint64(47_000)
    counts = [np.frombuffer(c, "<u2" if len(c) == 128 else "<u4").astype(np.int64) for c in map(jaccard._classes, (a, b))]
    assert jaccard._may_be_linked(np.array([len(a), len(b)]), np.array(counts), jaccard.Threshold(90, 100)).all()


def test_the_driver_holds_a_byte_or_a_bit_for_each_place(spark, documents, monkeypatch):
    sizes, broadcast = [], type(spark.sparkContext).broadcast

    def recorded(context, value):
        if isinstance(value, np.ndarray):
            sizes.append(value.nbytes)
        return broadcast(context, value)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", recorded)
    rows = near_copies(6, n=30)
    assert run(documents(rows)) == brute(rows)
    assert sizes == [1 << jaccard.ORDER_BITS, *[(1 << jaccard.MARK_BITS) // 8] * 3]


def test_marks_tell_numbers_apart(spark):
    rng = np.random.default_rng(1)
    numbers = rng.integers(-(1 << 63), 1 << 63, 3000)
    rows = spark.createDataFrame([(int(n),) for n in numbers[:1000]], "node long").repartition(3)
    bits = jaccard._marks(rows, lambda columns: columns[0]).value
    found = jaccard._marked(bits, numbers.view(np.uint64))
    shift = np.uint64(64 - jaccard.MARK_BITS)
    places = numbers.view(np.uint64) >> shift
    assert found.tolist() == np.isin(places, places[:1000]).tolist()
    assert [bool(jaccard._marked(bits, n)) for n in numbers.view(np.uint64)[990:1010]] == found[990:1010].tolist()


def test_marks_follow_what_is_marked(spark):
    """With many more numbers than the least marks, next to none of the others is taken for one of them."""
    rows = spark.range(1 << 20).select(F.xxhash64("id").alias("node"))
    bits = jaccard._marks(rows, lambda columns: columns[0]).value
    assert len(bits) * 8 >= 8 << 20
    own = rows.limit(1000).toPandas()["node"].to_numpy().view(np.uint64)
    assert jaccard._marked(bits, own).all()
    others = np.random.default_rng(2).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    assert jaccard._marked(bits, others).mean() < 0.08


def test_shared_pivots_are_marked_evenly():
    """A set's first pivots are those with small numbers among equal ranks; their marks are spread all the same."""
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(0, 1 << 64, 400, dtype=np.uint64)) for _ in range(200)]
    ranks = np.zeros(1 << jaccard.ORDER_BITS, dtype=np.uint8)
    first = np.concatenate([jaccard._first_pivots(ranks, jaccard.Threshold(80, 100), s)[0] for s in sets])
    assert (first < np.uint64(1 << 62)).mean() > 0.9
    assert 0.2 < (jaccard._spread(first) < np.uint64(1 << 62)).mean() < 0.3


def test_texts_that_are_alone_are_not_shuffled(spark, documents):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(300))) for i in range(60)]
    rows += [(100, rows[0][1] + " more"), (101, rows[0][1]), (101, rows[0][1]), (102, "")]
    kept = jaccard.keep_one(jaccard.stored(documents(rows), "given"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(60), 102]
    moved = _metrics(kept._jdf.queryExecution().executedPlan(), "shuffleRecordsWritten")
    assert moved and sum(m.value() for m in moved) <= 8


def test_stored_tables_leave_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = files.getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    table = jaccard.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _metrics(plan, name):
    """Values of a metric in all nodes of an executed plan, those of adaptive stages too."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        plan = plan.plan()
    found = [plan.metrics().apply(name)] if plan.metrics().contains(name) else []
    children = plan.children()
    for i in range(children.size()):
        found += _metrics(children.apply(i), name)
    return found
