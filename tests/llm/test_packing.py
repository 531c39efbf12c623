import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybook.llm import packing


@pytest.fixture(scope="module")
def reference():
    """Ids as the tokenizer library itself gives them."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.default_tokenizer())


TEXTS = ["", " ", "a", " a  b", "it's we'LL\n\n x", "漢字 और é", "<|endoftext|> x", "x\n" * 50, "9 99 999", "   a\x1cb"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_tokenizer(encoder, reference, text):
    assert [*encoder.ids(text).tolist(), 0] == reference(text)


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet=st.sampled_from(list("ab 's\n.é1\t ")), max_size=60))
def test_slices_give_the_same_ids(encoder_text):
    encoder = test_slices_give_the_same_ids.encoder
    whole = encoder.ids(encoder_text).tolist()
    kept, packing.SLICE = packing.SLICE, 3
    try:
        assert encoder.ids(encoder_text).tolist() == whole
    finally:
        packing.SLICE = kept


test_slices_give_the_same_ids.encoder = packing.Encoder(packing.default_tokenizer())


def check(rows, docs, reference, capacity, tasks):
    """Every id lies in one piece, windows are gapless, and little is left to pad."""
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    for members in windows.values():
        end = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == end and r["length"] > 0
            end += r["length"]
        assert end <= capacity
    expected = {}
    for i, text in docs:
        ids = reference(text)
        expected.setdefault((i, len(ids)), []).append(ids)
    assert set(pieces) == set(expected)
    for key, copies in expected.items():
        crcs = []
        for r in pieces[key]:
            crcs.append((r["start"], r["length"], r["ids_crc32"]))
        assert sum(length for _, length, _ in crcs) == len(copies) * key[1]
        for start, length, crc in crcs:
            assert crc in {zlib.crc32(np.array(c[start : start + length], dtype="<u4").tobytes()) for c in copies}
    total = sum(r["length"] for r in rows)
    assert len(windows) <= -(-total // capacity) + tasks


def test_pieces(spark, documents, reference):
    docs = [(i, f"word{i} and more " * (i % 90)) for i in range(400)]
    docs += [(500, "long text " * 3000), (None, "no id"), (501, None), (502, ""), (503, "same"), (503, "same")]
    rows = packing.pack(documents(docs, 3), capacity=128).collect()
    check(rows, docs, reference, 128, 3)


def test_empty_table(spark, documents):
    assert packing.pack(documents([])).collect() == []


def brute_level(count, size, capacity):
    """The level whose choice leaves the smallest sum of squares, by trying all."""

    def after(level):
        n = count.copy()
        if level:
            n[level] -= 1
        if level + size < capacity:
            n[level + size] += 1
        return int((n**2).sum())

    levels = [0, *[h for h in range(1, capacity - size + 1) if count[h]]]
    return min(after(h) for h in levels), after


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 4), min_size=12, max_size=12), st.integers(1, 11))
def test_chosen_level_minimises_the_squares(counts, size):
    packer = packing.Packer(12, 100)
    packer.count[1:12] = counts[1:]
    best, after = brute_level(packer.count, size, 12)
    assert after(packer._level_for(size)) == best


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 6))
def test_round_trip_with_few_open_windows(sizes, most):
    packer = packing.Packer(16, most)
    docs = [np.arange(n, dtype="<u4") + 100 * i for i, n in enumerate(sizes)]
    windows = [w for i, ids in enumerate(docs) for w in packer.place(i, ids)]
    assert packer.open <= most
    windows += packer.finish()
    got = {}
    for w in windows:
        assert sum(len(p[2]) for p in w) <= 16
        for i, start, ids, _ in w:
            got.setdefault(i, []).append((start, ids.tolist()))
    for i, ids in enumerate(docs):
        assert [x for _, part in sorted(got[i]) for x in part] == ids.tolist()
    assert len(windows) == -(-sum(sizes) // 16)


@pytest.fixture(scope="module")
def unchanged():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_added_tokens_have_their_own_ids(unchanged):
    end = "<|endoftext|>"
    tokenizer = packing.Tokenizer(packing.default_tokenizer())
    assert tokenizer.ids(f"a {end} x").tolist() == [64, 220, 50256, 2124]
    for text in [*TEXTS, end, end * 3, f" {end}\n\n{end} it's", "<|endoftext|", f"<|endof{end}text|>", f"x{end}  \t"]:
        assert [*tokenizer.ids(text).tolist(), 0] == unchanged(text)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", " ", "a", "\n", "'s", "é", "  "]), max_size=12))
def test_ids_around_added_tokens(pieces):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    if not hasattr(test_ids_around_added_tokens, "both"):
        test_ids_around_added_tokens.both = packing.Tokenizer(path), Tokenizer.from_file(path)
    ours, theirs = test_ids_around_added_tokens.both
    text = "".join(pieces)
    assert ours.ids(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_pieces_with_added_tokens(spark, documents, unchanged):
    docs = [(i, f"word{i} <|endoftext|> and more" * (i % 9)) for i in range(60)]
    check(packing.pack(documents(docs, 2), capacity=64).collect(), docs, unchanged, 64, 2)


@pytest.mark.parametrize("run", [" ", "\n", "\t\n ", " ", "  ", "a", "7", "!"])
@pytest.mark.parametrize("frame", ["{}", "x{}", "{}x", "x {} y", "<|endoftext|>{}<|endoftext|>", "{}\nNo. {}"])
def test_long_runs(run, frame):
    """Runs of one kind of characters, beyond what the pattern's look-ahead can hold, as the library encodes them."""
    text = frame.replace("{}", run * 30_000)
    from tokenizers import Tokenizer as Library

    want = Library.from_file(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids
    assert packing.Tokenizer(packing.default_tokenizer()).ids(text).tolist() == want


@pytest.mark.parametrize("run", [" ", "\n", "a"])
def test_five_million_characters(spark, documents, run):
    got = packing.pack(documents([(1, run * 5_000_000)])).collect()
    assert sum(r["length"] for r in got) == got[0]["doc_tokens"]
