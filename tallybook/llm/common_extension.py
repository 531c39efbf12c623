"""Longest common extensions of words of many documents, by difference-cover samples.

Words are numbers in one array, each document closed by a number of its own. Only suffixes that
start at places whose remainder modulo ``PERIOD`` is in a difference cover are sorted: any two
places reach two such ones within fewer than ``PERIOD`` steps, the same for both. An extension
compares those few words; if all agree, what follows is the least common prefix between two sorted
samples, which a sparse table answers. Suffixes are sorted within their document.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set; every remainder is the difference of two members.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
_FAR = np.int64(1) << 60


def _meeting() -> np.ndarray:
    """For two remainders, the least number of steps after which both are in the cover."""
    member = np.isin(np.arange(PERIOD), COVER)
    steps = np.arange(PERIOD)
    a = member[(np.arange(PERIOD)[:, None] + steps) % PERIOD]
    return np.argmax(a[:, None, :] & a[None, :, :], axis=2)


_MEETING = _meeting()


class _Least:
    """Least value of any range of an array, by a sparse table."""

    def __init__(self, values: np.ndarray):
        rows = [values]
        while (1 << len(rows)) <= len(values):
            half = 1 << (len(rows) - 1)
            below = rows[-1].copy()
            below[:-half] = np.minimum(rows[-1][:-half], rows[-1][half:])
            rows.append(below)
        self._table = np.stack(rows) if len(values) else np.empty((1, 0), dtype=np.int64)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        return np.minimum(self._table[level, first], self._table[level, last + 1 - (1 << level)])


class CommonExtension:
    """``words``: the array; ``starts``: where each document begins, its closing number at its end."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self._words = words
        member = np.isin(np.arange(PERIOD), COVER)
        self._number = np.cumsum(np.resize(member, len(words))) - 1  # of the sample at a sampled place
        at = np.flatnonzero(np.resize(member, len(words)))
        document = np.searchsorted(starts, at, side="right") - 1
        self._rank, common = self._sorted(at, document)
        self._least = _Least(common)

    def _sorted(self, at: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the samples, and the common prefix of each rank with the one before it."""
        words, m = self._words, len(at)
        rank = np.searchsorted(document, document)  # samples of one rank are still together; a document's at first
        common = np.full(m + 1, _FAR, dtype=np.int64)
        common[np.unique(rank)] = 0
        left = np.arange(m)

        def split(left, key, agreed) -> np.ndarray:
            """Tell samples of one rank apart by ``key``; returns those still together with others."""
            order = np.lexsort((key, rank[left]))
            left, key = left[order], key[order]
            old = rank[left]
            new_rank = np.concatenate([[True], old[1:] != old[:-1]])
            new = new_rank | np.concatenate([[True], key[1:] != key[:-1]])
            place = np.arange(len(left))
            first = np.maximum.accumulate(np.where(new, place, 0))
            base = np.maximum.accumulate(np.where(new_rank, place, 0))
            rank[left] = old + first - base
            cut = np.flatnonzero(new & ~new_rank)
            common[rank[left[cut]]] = agreed(left[cut - 1], left[cut])
            ends = np.append(new[1:], True)
            return left[~(new & ends)]

        for step in range(PERIOD):
            if not len(left):
                return rank, common[:m]
            # a sample whose document ended before this step has been told apart at its closing number
            left = split(left, words[at[left] + step], lambda a, b, step=step: step)
        span = PERIOD
        while len(left):
            # the sample ``span`` words on; its rank tells blocks of ``span`` words apart
            ahead = self._number[at[left] + span]
            before, known = rank.copy(), _Least(common[:m])

            def agreed(a, b, span=span, before=before, known=known):
                x, y = before[self._number[at[a] + span]], before[self._number[at[b] + span]]
                return span + known.of(np.minimum(x, y) + 1, np.maximum(x, y))

            left = split(left, before[ahead], agreed)
            span *= 2
        return rank, common[:m]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from ``a`` and ``b`` on, two places of the same document, a < b."""
        words = self._words
        out = _MEETING[a % PERIOD, b % PERIOD]
        left, step = np.arange(len(a)), 0
        far = []
        while len(left):
            met = out[left] == step
            far.append(left[met])
            left = left[~met]
            differ = words[a[left] + step] != words[b[left] + step]
            out[left[differ]] = step
            left = left[~differ]
            step += 1
        far = np.concatenate(far) if far else np.empty(0, dtype=np.int64)
        x = self._rank[self._number[a[far] + out[far]]]
        y = self._rank[self._number[b[far] + out[far]]]
        out[far] += self._least.of(np.minimum(x, y) + 1, np.maximum(x, y))
        return out
