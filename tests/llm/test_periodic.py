"""Runs against a plain scan of every period, common extensions against comparison word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallybook.llm import common_extension, periodic


def plain_runs(words):
    found, n = {}, len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(6, 4 * p):
                found.setdefault((start, i + p - start), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def some_words(rng):
    n, k = rng.choice([0, 3, 6, 20, 100, 700]), rng.choice([1, 2, 3, 5, 50])
    words = [str(rng.randrange(k)).encode() for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 4 + 1))
        for i in range(a, min(n, a + p * rng.choice([4, 5, 9]))):
            words[i] = words[a + (i - a) % p]
    return words


def test_cover():
    period, cover = common_extension.PERIOD, common_extension.COVER
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("kinds", [1, 2, 1000])
def test_common_extension(kinds):
    rng = random.Random(kinds)
    lengths = [rng.choice([6, 57, 130, 400]) for _ in range(6)]
    parts = []
    for k, n in enumerate(lengths):
        unit = [rng.randrange(kinds) for _ in range(rng.choice([1, 3, 60, n]))]
        parts += [(unit * n)[:n], [-1 - k]]
    words = np.array([w for part in parts for w in part])
    starts = np.cumsum([0, *[n + 1 for n in lengths[:-1]]])
    extension = common_extension.CommonExtension(words, starts)
    a, b = [], []
    for s, n in zip(starts, lengths, strict=True):
        for _ in range(60):
            i, j = sorted(rng.sample(range(n), 2))
            a.append(s + i)
            b.append(s + j)
    got = extension.of(np.array(a), np.array(b))
    for i, j, n in zip(a, b, got.tolist(), strict=True):
        assert (words[i : i + n] == words[j : j + n]).all() and words[i + n] != words[j + n]


@pytest.mark.parametrize("probes", [7, periodic.PROBES])
def test_runs(monkeypatch, probes):
    monkeypatch.setattr(periodic, "PROBES", probes)
    rng = random.Random(probes)
    for _ in range(40 if probes == 7 else 150):
        documents = [some_words(rng) for _ in range(rng.randint(1, 6))]
        for words, runs in zip(documents, periodic.find_runs(documents), strict=True):
            assert runs == plain_runs(words)
            assert periodic.kept_words(words, runs) == plain_kept(words, runs)


def test_digest_and_edge_cases(spark, documents):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b y", "A a A a A a A a", "é é é é é é é é é é é é"]
    rows = [*enumerate(texts), (3, "b b b b b b b"), (3, "b b b b b b b"), (None, "c c c c c c")]
    got = periodic.digest(documents(rows))
    assert "odd name" in got.columns
    found = sorted((r.asDict() for r in got.collect()), key=str)
    want = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        want.append(
            {
                "lang": None, "source": "s", "n_chars": None if text is None else len(text), "shard": "x", "odd name": 1, "doc_id": doc_id,
                "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
                "exponent_milli": 1000 * best[1] // best[2] if runs else None,
                "runs_sha256": hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
                "collapsed_sha256": hashlib.sha256(b" ".join(plain_kept(words, runs))).hexdigest(),
            }
        )
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(found, key=key) == sorted(want, key=key)


def test_planted_runs(spark, documents):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text) for i in range(60)]
    got = {r["doc_id"]: r["n_runs"] for r in periodic.periodic_runs(documents(rows)).collect()}
    for i, _ in rows:
        g, last = divmod(zlib.crc32(str(i).encode()), 10)
        words = text.encode().split()
        if last == 0:
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)]
        assert got[i] == len(plain_runs(words))
    assert any(got.values())


def test_collapse_keeps_the_rest(spark, documents):
    got = periodic.collapse(documents([(1, "so  it goes go go go go go go on")])).first()
    assert got["collapsed"] == "so it goes go on" and got["text"].startswith("so  it")
    assert [tuple(r) for r in got["runs"]] == [(3, 6, 1)]


def test_empty_table(spark, documents):
    assert periodic.periodic_runs(documents([(1, "x")]).filter("doc_id = 0")).collect() == []


def test_very_long_texts():
    """Text of some megabytes, and no more than seconds for it."""
    unit = [str(i).encode() for i in range(700)]
    for words, runs in (
        ([b"a"] * 400_000, [(0, 400_000, 1)]),
        ((unit * 600)[:400_000], [(0, 400_000, 700)]),
        ([str(i).encode() for i in range(400_000)], []),
    ):
        assert periodic.find_runs([words]) == [runs]
