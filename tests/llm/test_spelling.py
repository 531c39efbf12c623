"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from tallybook.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(counts):
    out, forms = {}, {}
    for word, n in counts.items():
        near = [(-m, other) for other, m in counts.items() if one_edit(word, other)]
        best = min(near, default=None)
        if best and -best[0] >= 2 * n:
            forms[word] = best[1]
        out[word] = [forms.get(word), n, len(near), counts[forms[word]] if word in forms else None]
    rows = []
    for word, (form, n, n_near, form_n) in out.items():
        root = word
        while root in forms:
            root = forms[root]
        rows.append((word, form, root, n, n_near, form_n))
    return sorted(rows)


def plain_counts(rows, spoil):
    counts = Counter()
    for doc_id, text in rows:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if spoil and h % spoil == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return counts


def collected(df):
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("deepest", [0, 2, 64])
def test_pairs_of_sorted_lists(deepest):
    rng = random.Random(deepest)
    for _ in range(150):
        lists = []
        for _ in range(rng.randint(1, 4)):
            size, kinds = rng.choice([1, 2, 3, 5, 9]), rng.choice([1, 2, 3])
            lists.append(
                sorted({bytes(rng.choices(b"abc"[:kinds], k=size + rng.randint(0, 1))) for _ in range(rng.randint(1, 30))})
            )
        rows = [w for words in lists for w in words]
        first = np.repeat(np.cumsum([0, *map(len, lists[:-1])]), [len(x) for x in lists])
        length = np.array([len(w) for w in rows])
        data = np.frombuffer(b"".join(rows), dtype=np.uint8)
        a, b, begins = spelling.near_in_lists(data, np.cumsum(length) - length, length, first, deepest)
        want = [
            (i, j, v.startswith(w) or w.startswith(v))
            for i, v in enumerate(rows)
            for j, w in enumerate(rows)
            if first[i] == first[j] and one_edit(v, w)
        ]
        assert sorted(zip(a.tolist(), b.tolist(), begins.tolist(), strict=True)) == sorted(want)


def some_words(rng, n):
    seeds = ["".join(rng.choices("abcdeé", k=rng.randint(5, 9))) for _ in range(max(1, n // 6))]
    words = set()
    while len(words) < n:
        word = rng.choice(seeds)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(word))
            word = word[:at] + rng.choice(["", rng.choice("abcdeéÿ"), rng.choice("ab") + word[at]]) + word[at + 1 :]
        if len(word) >= 5:
            words.add(word)
    return {w: rng.randint(3, 60) for w in sorted(words)}


@pytest.mark.parametrize("limit", [1, 3, 1 << 14])
def test_words(spark, limit):
    """Groups of any size, split or not, give the pairs of a plain comparison, each once."""
    counts = some_words(random.Random(limit), 250)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert collected(spelling.group_variants(words, limit=limit)) == plain_variants(counts)


def test_texts(spark, documents):
    rng = random.Random(5)
    words = list(some_words(rng, 120))
    rows = [(i, " ".join(rng.choices(words, k=60)).replace("a", "A", 3) + " Ünïcode×÷ naïve 中文 ab") for i in range(40)]
    rows += [(None, "naïve naive naïve"), (7, None), (8, ""), (9, "ZZZZZ ZZZZZ"), (9, "ZZZZZ ZZZZZ")]
    counts = {w: n for w, n in plain_counts(rows, 97).items() if n >= 3}
    assert collected(spelling.spelling_variants(documents(rows, parts=4))) == plain_variants(counts)
    plain = {r["word"]: r["n"] for r in spelling.word_counts(documents(rows, parts=4)).collect()}
    assert plain == plain_counts(rows, None)


def test_chain_of_forms(spark):
    counts = {"aaaaa" + "b" * i: 2**i * 3 for i in range(20)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert collected(spelling.group_variants(words)) == plain_variants(counts)


def test_long_words(spark):
    """Words longer than the depth of the array code, among them ones of 200,000 letters."""
    long = "a" * 100_000 + "b" * 100_000
    counts = {long: 90, "c" + long: 9, long + "c": 8, long[:50_000] + "c" + long[50_000:]: 4, long[1:]: 3, "d" + long[1:]: 5}
    counts |= {"x" * 150 + c: i + 3 for i, c in enumerate(["", "y", "xz", "q"])}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert collected(spelling.group_variants(words)) == plain_variants(counts)


def test_empty_tables(spark, documents):
    assert spelling.spelling_variants(documents([(1, "x")]).filter("doc_id = 0")).collect() == []
    assert spelling.spelling_variants(documents([(1, "words that occur once")])).collect() == []


def test_ratio_below_two(spark):
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([("words", 3)], "word string, n long"), ratio=1)
