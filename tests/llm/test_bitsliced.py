import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybook.llm import bitsliced


def brute(rows, every, k=5):
    """Ranks by sorting all scores."""
    vectors = []
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        vectors.append((i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64)))
    out = []
    for q, a in vectors:
        if q % every == 0:
            scored = sorted((-int(a @ b), i) for i, b in vectors if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, every, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return sorted(tuple(r) for r in bitsliced.top_k(df, F.col("vec_id") % every == 0, **options).collect())


def test_against_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 12)], 0) for i in rng.permutation(900)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(300)]  # a third are copies of one vector
    monkeypatch.setattr(bitsliced, "CHUNK", 128)
    monkeypatch.setattr(bitsliced, "BLOCK", 4)
    assert run(spark, rows, 50) == brute([(i, v) for i, v, _ in rows], 50)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -1.0], 0), (1, [1.0, -1.0], 0), (2, None, 0), (3, [None, 1.0], 0), (4, [nan, 1.0], 0),
        (5, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (6, [], 0), (7, [0.5], 0), (50, [0.001, -0.001], 0), (8, [0.0, 0.0], 0),
    ]
    assert run(spark, rows, 50) == brute([(i, v) for i, v, _ in rows], 50)
    assert run(spark, [(0, [1.0], 0)], 50) == []
    assert run(spark, [], 50) == []


@pytest.mark.parametrize("extreme", [1.0, 1000.0])
def test_large_components(spark, extreme):
    rows = [(i, [extreme * (-1) ** i, extreme / (i + 1), -extreme], 0) for i in range(60)]
    assert run(spark, rows, 10) == brute([(i, v) for i, v, _ in rows], 10)


@given(st.lists(st.integers(-(2**26), 2**26), min_size=1, max_size=20))
def test_signed_digits(values):
    values = np.array(values)
    plus, minus = bitsliced.signed_digits(values)
    assert (plus - minus == values).all()
    assert not ((plus | minus) & ((plus | minus) >> 1)).any()


@settings(deadline=None, max_examples=25)
@given(st.integers(1, 300), st.integers(1, 6), st.integers(1, 12), st.integers(0, 10**6))
def test_chunk(n, dim, k, seed):
    rng = np.random.default_rng(seed)
    ids = rng.choice(2 * n, n, replace=False).astype(np.int64)
    vectors = rng.integers(-9, 9, (n, dim))
    chunk = bitsliced.Chunk(*bitsliced.sliced(ids, vectors))
    query, own = rng.integers(-9, 9, dim), int(ids[0])
    found, scores = chunk.top(query, own, k)
    best = sorted((-int(s), int(i)) for s, i in zip(vectors @ query, ids) if i != own)[:k]
    assert sorted((-int(s), int(i)) for s, i in zip(scores, found)) == best


def exact(rows, every, k=5):
    """As ``brute``, in Python's integers."""
    vectors = [(i, [int(256 * np.float64(np.float32(x)) // 1) for x in v]) for i, v, _ in rows]
    out = []
    for q, a in vectors:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("extreme", [2.0**18, 3e6, 1e7])
def test_components_of_any_size(spark, extreme):
    rows = [(i, [extreme * (-1) ** i, extreme / (i + 1), 0.25 - i], 0) for i in range(30)]
    rows += [(100 + i, [0.5, float(i), -1.0], 0) for i in range(10)]
    assert run(spark, rows, 10) == exact(rows, 10)


def test_components_beyond_longs(spark):
    """Integers of over 64 bits; the best scores fit a long, others are far below."""
    rows = [(1, [1e30, 0.0], 0), (2, [-1e30, 2.0], 0), (3, [3e12, 1.0], 0), (10, [0.0, 7.0], 0), (20, [0.0, -1.5], 0)]
    rows += [(30 + i, [0.0, float(i)], 0) for i in range(1, 8)]
    assert run(spark, rows, 10) == exact(rows, 10)
    negative = [(10, [-1.0, 1.0], 0), (1, [1e30, 0.0], 0), *[(30 + i, [0.0, float(i)], 0) for i in range(1, 8)]]
    assert run(spark, negative, 10) == exact(negative, 10)


def test_a_score_that_fits_no_long_is_an_error(spark):
    with pytest.raises(Exception, match="fit a long"):
        run(spark, [(10, [1e30], 0), (1, [1e30], 0)], 10)
    with pytest.raises(Exception, match="fit a long"):
        run(spark, [(10, [1e30], 0), (1, [-1e30], 0)], 10)
