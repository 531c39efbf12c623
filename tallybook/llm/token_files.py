"""Token ids as files: one flat array of ids a shard, document boundaries as Elias-Fano numbers.

A shard is ``<name>.ids``, the ids of its documents one after the other (little-endian, two bytes each
where the vocabulary allows it, else four; no header, so it can be memory-mapped), and ``<name>.idx``:
the boundaries and the document ids, both as ``EliasFano``, and a flag where ids are null. Shards
are ranges of ascending ``doc_id``; ``manifest`` (a Parquet table in the same folder) names the
files that count, in order, with the number of ids before each.

A task writes files of a name of its own and is counted by the row it returns, which Spark commits
once; files of a task that was lost or ran twice are not in the manifest. Documents are ranged by
id, then text, then row, so rows that share an id are spread like others.

Defined results: a null text is an empty one (the end id alone); documents with a null id come last;
documents of one id come in the order of a hash of their text; repeated rows are documents of their own;
an empty table gives an empty manifest; other columns are ignored. Texts are tokenised whole.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.llm.elias_fano import EliasFano
from tallybook.llm.tables import shared_folder

END = 1
MAGIC = b"tallyids"
_HEAD = struct.Struct("<8sBQQq")  # magic, bytes an id, documents, documents without an id, least id
#: Bytes of text a shard holds, about.
SHARD_BYTES = 128 << 20
#: Bytes of text that are tokenised at a time, and bytes of ids that are read at a time.
SLICE = 1 << 20
#: Words whose ids a Python worker remembers (up to twice as many), and the longest of them.
REMEMBERED, LONGEST = 1 << 18, 256

#: ASCII letters, and those of U+00C0 to U+00FF: normalising leaves them single letters.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

WRITTEN = "shard long, name string, n_docs long, n_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there; every executor must reach it."""
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file:")


class WordEncoder:
    """Ids of texts by a tokenizer file that drops white space, as ``tokenizers`` gives them.

    No token of such a file reaches over white space, so what stands between it is encoded once and
    remembered; the words of many texts that are new are encoded in one call. ``normalizer`` and
    ``pre_tokenizer`` of the file must be of that kind: a probe is compared when the file is opened.
    """

    _PROBE = "It's  one\tof\n\nthe 12 ones: <|endoftext|>x Áb ́c d"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        # tokens that end a word; what is made of letters alone is one word, with one such token
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = [token.content.lower().encode() for token in added]
        large, small = ("".join(map(chr, range(first, first + 26))) for first in (65, 97))
        ids = [self._tokenizer.encode(f"{x} {' '.join(x)}", add_special_tokens=False).ids for x in (large, small)]
        self._lowers = ids[0] == ids[1]
        # a sign that is a word and a token of its own, to stand between words that are encoded in one text
        alone = (c for c in "♥★●■♪" if len(self._tokenizer.encode(c, add_special_tokens=False).ids) == 1)
        self._sign = next(alone, "").encode()
        self._sign_id = self._tokenizer.encode(self._sign.decode(), add_special_tokens=False).ids[0] if self._sign else -1
        whole = self._tokenizer.encode(self._PROBE, add_special_tokens=False).ids
        if self.encoded([self._PROBE.encode()]) != [np.array(whole, dtype=self.dtype).tobytes()]:
            raise ValueError(f"{path} has tokens that depend on white space")

    def _small(self, text: bytes) -> bytes:
        """A-Z as small letters, where the file does the same and no added token is near."""
        small = text.lower() if self._lowers else text
        return text if any(token in small for token in self._added) else small

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if len(self._known) > REMEMBERED:  # words in use come back from the older half
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        out, open_ = [], []
        new: dict[bytes, bytes] = {}
        for text in texts:
            words = self._small(text).split()
            ids = list(map(known.get, words))
            if None in ids:
                at = [i for i, found in enumerate(ids) if found is None]
                for i in at:
                    word = words[i]
                    if word in older:
                        ids[i] = known[word] = older[word]
                    elif word not in new:
                        new[word] = b""
                open_.append((len(out), ids, [(i, words[i]) for i in at if ids[i] is None]))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if new:
            self._encode_new(new)
            known.update((w, i) for w, i in new.items() if len(w) <= LONGEST)
        for place, ids, missing in open_:
            for i, word in missing:
                ids[i] = new[word]
            out[place] = b"".join(ids)
        return out

    def _encode_new(self, new: dict[bytes, bytes]) -> None:
        """Give each word its ids; words of letters are encoded in one text, cut where a word ends."""
        letters = [w for w in new if _LETTERS.fullmatch(w)]
        ids = self._ids([b" ".join(letters)])[0]
        cuts = (np.flatnonzero(self._ends[ids]) + 1) * self.dtype.itemsize
        if len(cuts) == len(letters):
            data, at = ids.tobytes(), 0
            for word, cut in zip(letters, cuts.tolist(), strict=True):
                new[word], at = data[at:cut], cut
        others = [w for w, found in new.items() if not found]
        if self._sign:
            plain = [w for w in others if self._sign not in w]
            ids = self._ids([(b" " + self._sign + b" ").join(plain)])[0]
            at = np.flatnonzero(ids == self._sign_id)
            if len(at) == len(plain) - 1:
                data, size = ids.tobytes(), self.dtype.itemsize
                starts, ends = np.append(0, at + 1) * size, np.append(at, len(ids)) * size
                for word, start, end in zip(plain, starts.tolist(), ends.tolist(), strict=True):
                    new[word] = data[start:end]
                others = [w for w in others if self._sign in w]
        for word, ids in zip(others, self._ids(others), strict=True):
            new[word] = ids.tobytes()

    def _ids(self, words: list[bytes]) -> list[np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype) for e in found]

    def pieces(self, data: bytes) -> Iterator[bytes]:
        """The ids of a long text in pieces that end at white space."""
        at = 0
        while at < len(data):
            end = at + SLICE
            while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            yield self.encoded([data[at:end]])[0]
            at = end


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker: what it remembers serves all tasks it runs."""
    return WordEncoder(path)


class _Writer:
    """One shard being written."""

    def __init__(self, folder: str, shard: int, width: int):
        self._files, path = opened(folder)
        self.shard, self.name, self._width = shard, f"shard-{shard:06d}-{uuid.uuid4().hex}", width
        self._path = f"{path}/{self.name}"
        self._files.create_dir(path, recursive=True)
        self._out = self._files.open_output_stream(f"{self._path}.ids")
        self._ids: list[int] = []
        self._ends: list[int] = []
        self._nulls = self._at = 0

    def add(self, doc_id: int | None, pieces: Iterable[bytes]) -> None:
        for piece in pieces:
            self._out.write(piece)
            self._at += len(piece) // self._width
        self._ends.append(self._at)
        if doc_id is None:
            self._nulls += 1
        else:
            self._ids.append(doc_id)

    def close(self) -> tuple[int, str, int, int]:
        self._out.close()
        least = self._ids[0] if self._ids else 0
        ids = np.array(self._ids, dtype=np.int64).astype(np.uint64) - np.array(least, dtype=np.int64).astype(np.uint64)
        head = _HEAD.pack(MAGIC, self._width, len(self._ends), self._nulls, least)
        starts = np.concatenate([np.zeros(1, dtype=np.uint64), np.array(self._ends, dtype=np.uint64)])
        with self._files.open_output_stream(f"{self._path}.idx") as out:
            out.write(head + EliasFano.of(starts).tobytes() + EliasFano.of(ids).tobytes())
        return self.shard, self.name, len(self._ends), self._at


class TokenFile:
    """A shard opened for reading: any document by its place, or all of them in order."""

    def __init__(self, folder: str, name: str):
        self._files, path = opened(folder)
        self._path = f"{path}/{name}"
        with self._files.open_input_file(f"{self._path}.idx") as f:
            data = f.read()
        magic, width, self.n_docs, self._nulls, self._least = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError(f"{name}.idx is not an index of token ids")
        self._dtype = np.dtype(f"<u{width}")
        self.starts, at = EliasFano.frombytes(data, _HEAD.size)
        self._ids, _ = EliasFano.frombytes(data, at)

    def doc_id(self, i: int) -> int | None:
        return None if i >= len(self._ids) else self._ids[i] + self._least

    def ids(self, i: int) -> np.ndarray:
        """The ids of document ``i`` of the shard."""
        width = self._dtype.itemsize
        start, end = self.starts[i], self.starts[i + 1]
        with self._files.open_input_file(f"{self._path}.ids") as f:
            return np.frombuffer(f.read_at((end - start) * width, start * width), dtype=self._dtype)

    def digests(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start in the shard, number of ids, CRC-32 of them as 32-bit numbers) of every document."""
        width = self._dtype.itemsize
        with self._files.open_input_stream(f"{self._path}.ids") as f:
            for at in range(0, self.n_docs, 1 << 16):
                bounds = self.starts.slice(at, min(at + (1 << 16), self.n_docs) + 1).astype(np.int64)
                ids = self._ids.slice(at, at + (1 << 16)).tolist()
                held, place = np.empty(0, dtype="<u4"), 0
                for k, (start, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    crc, left = 0, end - start
                    while left:
                        if place == len(held):
                            todo = min(int(bounds[-1]) - (end - left), SLICE // width)
                            held, place = np.frombuffer(f.read(todo * width), dtype=self._dtype).astype("<u4"), 0
                        part = held[place : place + left]
                        crc = zlib.crc32(part, crc)
                        left -= len(part)
                        place += len(part)
                    yield (ids[k] + self._least if k < len(ids) else None), start, end - start, crc


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, shards: int | None = None) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) into the files of ``folder`` and return its manifest.

    ``tokenizer`` is a path every executor can read. ``end`` is the id that closes each document.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    rows = docs.select(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES), min(4 * spark.sparkContext.defaultParallelism, size >> 22))
    placed = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = (F.col("doc_id").asc_nulls_last(), "h", "row")
    ranged = placed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = encoder = None

        def add_all(held: list[tuple[int | None, bytes]]) -> None:
            """Add documents whose texts are short together, or a single longer one."""
            if len(held) == 1:
                pieces = encoder.pieces(held[0][1])
                out.add(held[0][0], (p for part in (pieces, (closing,)) for p in part))
            else:
                for (doc_id, _), ids in zip(held, encoder.encoded([data for _, data in held]), strict=True):
                    out.add(doc_id, (ids + closing,))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = _encoder(path)
                out = _Writer(folder, TaskContext.get().partitionId(), encoder.dtype.itemsize)
                closing = np.array([end], dtype=encoder.dtype).tobytes()
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode()
                if held and size + len(data) > SLICE:
                    add_all(held)
                    size = 0
                held.append((doc_id, data))
                size += len(data)
            add_all(held)
        if out is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, out.close(), strict=True))], schema=schema)

    names = [c.split()[0] for c in WRITTEN.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "name" else pa.int64()) for n in names])
    ranged.mapInArrow(run, WRITTEN).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, in order, with the number of ids in all shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard, not per document
    shards = spark.read.schema(WRITTEN).parquet(f"{folder}/manifest")
    return shards.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _per_shard(shards: DataFrame, schema: str, read: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """Rows that ``read`` makes of each shard, one task a shard."""
    n = max(1, shards.count())
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                rows: list[tuple] = []
                for row in read(shard):
                    rows.append(row)
                    if len(rows) == 1 << 14:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return shards.repartitionByRange(n, "shard").mapInArrow(run, schema)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: its id, the number of ids before it, its ids' number and CRC-32."""

    def read(shard: dict) -> Iterator[tuple]:
        for doc_id, start, n, crc in TokenFile(folder, shard["name"]).digests():
            yield doc_id, shard["first_token"] + start, n, crc

    return _per_shard(manifest(spark, folder), "doc_id long, start long, n_tokens long, ids_crc32 long", read)


def token_files(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to a new folder of the shared one, and read every document back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tallybook-llm/token-ids-{uuid.uuid4().hex}"
    write(docs, folder)
    return read_digests(spark, folder)
