"""Token files against the tokenizer library, and Elias-Fano numbers against plain arrays."""

import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallybook.llm import token_files
from tallybook.llm.elias_fano import EliasFano
from tallybook.llm.tables import shared_folder

PLAIN = Tokenizer.from_file(token_files.default_tokenizer())


def plain_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("top", [0, 1, 50, 10**6, 2**63, 2**64 - 1])
@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 3000])
def test_elias_fano(top, n):
    rng = np.random.default_rng(n)
    values = np.sort((rng.random(n) * top).astype(np.uint64))
    values[-1] = top
    stored, end = EliasFano.frombytes(b"xyz" + EliasFano.of(values).tobytes(), 3)
    assert end == 3 + len(EliasFano.of(values).tobytes())
    assert [stored[i] for i in range(n)] == values.tolist()
    for a, b in ((0, n), (n // 3, n // 2), (n - 1, n + 5), (n, n)):
        assert (stored.slice(a, b) == values[a:b]).all()
    with pytest.raises(IndexError):
        stored[n]


def test_elias_fano_far_apart_and_close():
    values = np.concatenate([np.arange(5000), [10**9], 10**9 + np.arange(5000) // 1000]).astype(np.uint64)
    stored, _ = EliasFano.frombytes(EliasFano.of(values).tobytes())
    assert [stored[i] for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.arange(0, 400 * 100_000, 400, dtype=np.uint64)
    assert len(EliasFano.of(values).tobytes()) < 100_000 * 1.5  # 64-bit numbers would take 800,000 bytes


def test_elias_fano_refuses_unsorted():
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))


ODD = st.text(alphabet=st.sampled_from("aB cé́İΣ\n\t  \x1c\x85'st!12퟿\U0001f600<|>endoftx"), max_size=60)


LETTERS = st.lists(st.text(alphabet="abZÀÿßØö×÷'", min_size=1, max_size=9), max_size=12).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(ODD, LETTERS, st.text(max_size=80)))
def test_ids_of_the_library(text):
    encoder = token_files.WordEncoder(token_files.default_tokenizer())
    got = np.frombuffer(b"".join(encoder.pieces(text.encode())), encoder.dtype)
    assert got.tolist() == plain_ids(text)[:-1]


def test_small_slices_and_memory(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 10)
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    encoder = token_files.WordEncoder(token_files.default_tokenizer())
    text = "one two <|endoftext|> three four five\nsix seven " * 5
    assert np.frombuffer(b"".join(encoder.pieces(text.encode())), encoder.dtype).tolist() == plain_ids(text)[:-1]


def expected(rows):
    """Ascending ids, nulls last; rows of one id in the order they were given to this helper."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = plain_ids(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark, documents):
    rows = [(5, "Some text"), (-3, None), (2**62, ""), (7, "a<|endoftext|>b"), (None, "no id"), (6, "x " * 5000), (8, " \n\t ")]
    got = token_files.token_files(documents(rows)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)


def test_many_shards_and_random_access(spark, documents):
    rows = [(i * 37 % 1001 - 300, f"Document {i} has " + "word " * (i % 50)) for i in range(500)]
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    manifest = token_files.write(documents(rows, parts=7), folder, shards=6).collect()
    assert len(manifest) == 6
    want = expected(rows)
    assert sorted(map(tuple, token_files.read_digests(spark, folder).collect()), key=lambda r: r[1]) == want
    texts = dict(rows)
    for shard in manifest:
        file = token_files.TokenFile(folder, shard["name"])
        for i in (0, file.n_docs // 2, file.n_docs - 1):
            assert file.ids(i).tolist() == plain_ids(texts[file.doc_id(i)])


def test_repeated_rows_of_one_id_are_spread(spark, documents):
    rows = [(4, "same words")] * 400 + [(9, "other")]
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    manifest = token_files.write(documents(rows, parts=4), folder, shards=4).collect()
    assert max(m["n_docs"] for m in manifest) < 250
    got = sorted(map(tuple, token_files.read_digests(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_empty_table(spark, documents):
    assert token_files.token_files(documents([(1, "x")]).filter("doc_id = 0")).collect() == []


def test_block_borders(monkeypatch, tmp_path):
    """Reading in blocks of a few ids gives what was written."""
    monkeypatch.setattr(token_files, "SLICE", 6)
    out = token_files._Writer(str(tmp_path), 0, 2)
    lengths = [0, 1, 5, 2, 3, 0, 11]
    ids = [np.arange(n, dtype="<u2") + k for k, n in enumerate(lengths)]
    for k, one in enumerate(ids):
        out.add(k, iter([one.tobytes()]))
    _, name, n_docs, n_tokens = out.close()
    assert (n_docs, n_tokens) == (7, 22)
    got = list(token_files.TokenFile(str(tmp_path), name).digests())
    assert [(d, n, c) for d, _, n, c in got] == [(k, len(i), zlib.crc32(i.astype("<u4").tobytes())) for k, i in enumerate(ids)]


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000, "a" * 2_000_000, "word " * 400_000])
def test_very_long_texts(spark, documents, text):
    got = token_files.token_files(documents([(1, text)])).collect()
    ids = plain_ids(text)
    assert [tuple(r) for r in got] == [(1, 0, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))]
