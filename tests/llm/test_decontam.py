import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybook.llm import decontam
from tallybook.llm.fm_index import FMIndex, WaveletMatrix, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        own, hit, found = words(text), set(), set()
        for item, phrase in items:
            p = words(phrase)
            for at in range(max(1, len(p) - window + 1) if p and item is not None else 0):
                w = p[at : at + window]
                for j in range(len(own) - len(w) + 1):
                    if own[j : j + len(w)] == w:
                        hit.update(range(j, j + len(w)))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


def run(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.judge(decontam.find_passages(docs, benchmark, drop=("text",)))
    return sorted(
        (tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()),
        key=str,
    )


LONG = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, LONG), (2, "Tiny Item"), (2, "another"), (3, ""), (4, None), (None, "x y"), (10, "é1 ü"), (5, LONG.upper())]
DOCS = [
    (1, "start " + LONG + " end"),
    (2, " ".join(f"w{i}" for i in range(3, 16)) + " x" * 300),
    (3, " ".join(f"w{i}" for i in range(12))),
    (4, "tiny, ITEM! tiny\nitem another"),
    (5, None), (6, ""), (7, "!!! ..."), (7, "É1 ü é1 Ü"), (None, "another"), (8, "x y"), (8, "x y"),
    (9, "tiny item " * 5000),
]


def test_against_brute_force(spark, documents):
    assert run(spark, documents(DOCS), ITEMS) == brute(DOCS, ITEMS)


def test_blocks_of_the_benchmark(spark, documents, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 20)
    assert run(spark, documents(DOCS), ITEMS) == brute(DOCS, ITEMS)


def test_empty_tables(spark, documents):
    assert run(spark, documents([]), ITEMS) == []
    assert run(spark, documents(DOCS), []) == brute(DOCS, [])


def test_spans_are_cut_from_the_text(spark, documents):
    docs = documents([(1, "Keep THIS, tiny item; and that."), (2, "nothing"), (3, None)])
    found = decontam.find_passages(docs, spark.createDataFrame([(1, "tiny item")], "item_id long, text string"))
    left = {r["doc_id"]: r["text"] for r in decontam.remove_passages(found).collect()}
    assert left == {1: "Keep THIS, ; and that.", 2: "nothing", 3: None}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=5))
def test_index_finds_all_places(text, pattern):
    index = FMIndex(np.array(text), sample=4)
    padded = np.array([[0] * (5 - len(pattern)) + pattern])
    low, high = index.search(padded)
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == [i for i in range(len(text)) if text[i : i + len(pattern)] == pattern]


@given(st.lists(st.integers(0, 30), min_size=1, max_size=200))
def test_wavelet_ranks(symbols):
    symbols = np.array(symbols)
    matrix = WaveletMatrix(symbols, 5)
    at = np.arange(len(symbols) + 1)
    for s in set(symbols.tolist()):
        assert (matrix.rank(np.full(len(at), s), at) == np.concatenate([[0], np.cumsum(symbols == s)])).all()
    assert (matrix.access(at[:-1]) == symbols).all()


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
