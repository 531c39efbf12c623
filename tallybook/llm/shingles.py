"""Sets of word shingles as sorted 64-bit numbers, computed by array code over whole batches.

A word is hashed as a polynomial over its bytes (A-Z lower-cased) modulo 2 ** 64, multiplied
back to its first byte and mixed with its length; words of over 64 bytes are hashed by XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that are hashed at a time.
SLICE = 1 << 19
_LONG_WORD = 64
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: A number for each byte; white space is 0, capital letters are as small ones.
_VALUE = _mixed(np.arange(1, 257, dtype=_U))
_VALUE[65:91] = _VALUE[97:123]
_VALUE[_SPACE] = 0
_POWER_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out)


_POWER = _powers(_POWER_BASE, 2 * SLICE)
_INVERSE = _powers(pow(_POWER_BASE, -1, 1 << 64), 2 * SLICE)


def _hash_words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of all words; a word also begins at each of ``firsts``."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = firsts[firsts < len(data)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, dtype=_U), starts
    sums = np.add.reduceat(_VALUE[data] * _POWER[: len(data)], starts)
    lengths = np.add.reduceat(inside.astype(np.int64), starts)
    hashes = _mixed(sums * _INVERSE[starts] + lengths.astype(_U))
    for i in np.flatnonzero(lengths > _LONG_WORD):
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes().lower())
    return hashes, starts


def _hash_long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, in pieces that end at white space."""
    out, at = [], 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word of over SLICE bytes
                ahead = data[at:]
                size = next(
                    (i + int(g[0]) for i in range(0, len(ahead), SLICE) if len(g := np.flatnonzero(_SPACE[ahead[i : i + SLICE]]))),
                    len(ahead),
                )
                out.append(np.array([xxhash.xxh64_intdigest(ahead[:size].tobytes().lower())], dtype=_U))
                at += size
                continue
        out.append(_hash_words(data[at:end], np.empty(0, dtype=np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=_U)


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """A number for every ``width`` consecutive words, not mixed yet."""
    n = max(0, len(words) - width + 1)
    out = words[:n]
    for k in range(1, width):
        out = _mixed(out) + words[k : k + n]
    return out


def _set_of(words: np.ndarray, shingles: np.ndarray, width: int) -> np.ndarray:
    if len(words) >= width:
        return np.unique(shingles)
    if len(words) == 0:
        return np.empty(0, dtype=_U)
    return _mixed((_folded(words, len(words)) ^ _U(len(words))) + _U(_POWER_BASE))


def shingle_sets(texts: pa.Array, width: int = 3) -> Iterator[np.ndarray]:
    """The set of every text, in order: sorted hashes of its distinct shingles of ``width`` words.

    A text of fewer words has its whole sequence as one; a text without words, or null, has none.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        end = min(end, len(texts))
        piece = data[offsets[row] : offsets[end]]
        if len(piece) > SLICE:  # a single long text
            words = _hash_long(piece)
            yield _set_of(words, _mixed(_folded(words, width)), width)
        else:
            firsts = offsets[row : end + 1] - offsets[row]
            words, starts = _hash_words(piece, firsts)
            shingles = _mixed(_folded(words, width))
            at = np.searchsorted(starts, firsts).tolist()
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield _set_of(words[a:b], shingles[a : max(a, b - width + 1)], width)
        row = end
