"""Language identification with a blended-spectrum string kernel and kernel ridge regression.

Two texts are compared by the distinct n-grams they share, n from 1 to 3, over the bytes of
the lower-cased text with everything but letters folded to a space:
``k(x, y) = shared / sqrt(distinct in x * distinct in y)``. The kernel is approximated by
Nystroem landmarks: a text becomes its kernel values with the landmarks, and one ridge
regression per language (one against the rest) is solved in that space. Scoring a batch is two
matrix products: n-gram presence times landmark presence, times the weights.

The classifier is fitted on a bounded sample of labelled rows (``sample`` in all, the same
expected number from each language, taken by a hash of the text and id; with very many languages
``LEAST`` of each); the landmarks are a part of them, at least one of each language. Every label
that has a row with a text can be predicted. Prediction reads every text whole, long ones in slices.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is
every text where there is no labelled row to learn from; a null id or label is carried; equal
texts get equal results; ties go to the language first in the alphabet; an empty table gives
no rows; other columns are kept, and replaced where they have the name of a result column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.tables import with_columns_in_arrow

UNKNOWN = "und"
#: Labelled rows a classifier is fitted on, and how many of them are landmarks.
SAMPLE, LANDMARKS = 2400, 240
RIDGE = 0.05
#: Rows a language has in the sample (expected number), however many languages share it.
LEAST = 12
#: Characters of a text taken at a time, and texts scored at a time.
SLICE, SCORED = 1 << 18, 128

_LETTER = regex.compile(r"\p{L}")
#: Classes of bytes: 0 for no letter, 1-26 for letters, then one for each byte beyond ASCII.
_CLASS = np.array(
    [b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else b - 101 if b >= 128 else 0 for b in range(256)],
    dtype=np.int32,
)
_BASE = 27 + 128
_OFFSETS = (0, _BASE, _BASE + _BASE**2)
GRAMS = _BASE + _BASE**2 + _BASE**3


def _codes(text: str) -> list[np.ndarray]:
    """Numbers of the 1-, 2- and 3-grams, in text order; runs of non-letters count as one."""
    classes = _CLASS[np.frombuffer(text.lower().encode(), dtype=np.uint8)]
    classes = np.concatenate([[0], classes, [0]]).astype(np.int32)
    classes = classes[np.concatenate([[True], (classes[1:] != 0) | (classes[:-1] != 0)])]
    two = classes[:-1] * _BASE + classes[1:]
    return [classes, two + _OFFSETS[1], two[:-1] * _BASE + classes[2:] + _OFFSETS[2]]


def _slices(text: str):
    """A long text in slices that end at a space, which changes no n-gram."""
    at = 0
    while len(text) - at > SLICE:
        end = text.find(" ", at + SLICE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


class Presence:
    """Distinct n-grams of texts: their number, and which of a vocabulary there are."""

    def __init__(self):
        self._stamp = np.zeros(GRAMS, dtype=np.int32)

    def distinct(self, text: str) -> np.ndarray:
        """Numbers of the distinct n-grams, unordered."""
        found = [self._once(c) for piece in _slices(text) for c in _codes(piece)]
        codes = np.concatenate(found)
        return codes if len(text) <= SLICE else np.unique(codes)

    def _once(self, codes: np.ndarray) -> np.ndarray:
        order = np.arange(len(codes), dtype=np.int32)
        self._stamp[codes] = order  # the last place of a code stays
        return codes[self._stamp[codes] == order]


class Model:
    """Landmarks as n-gram presence, and regression weights per language."""

    def __init__(self, languages: list[str], vocabulary: np.ndarray, landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.vocabulary, self.landmarks, self.weights = languages, vocabulary, landmarks, weights

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts, given as n-gram numbers, with the landmarks."""
        place = self._places()
        present = np.zeros((len(sets), len(self.vocabulary) + 1), dtype=np.float32)
        for row, codes in zip(present, sets, strict=True):
            row[place[codes]] = 1
        sizes = np.array([max(1, len(codes)) for codes in sets], dtype=np.float32)
        return (present[:, :-1] @ self.landmarks) / np.sqrt(sizes)[:, None]

    def _places(self) -> np.ndarray:
        if not hasattr(self, "_place"):
            self._place = np.full(GRAMS, len(self.vocabulary), dtype=np.int32)
            self._place[self.vocabulary] = np.arange(len(self.vocabulary), dtype=np.int32)
        return self._place

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_place"}

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(sets) @ self.weights


def _solve(languages: list[str], labels: list[str], sets: list[np.ndarray], landmarks: int, ridge: float) -> Model:
    """Kernel ridge regression in the space of landmarks: minimises |K w - y|^2 + ridge * n * w' M w."""
    chosen: list[int] = []
    number = {language: k for k, language in enumerate(languages)}
    own = np.array([number[label] for label in labels])
    by_language: list[list[int]] = [[] for _ in languages]
    for i, language in enumerate(own.tolist()):
        by_language[language].append(i)
    for rows in by_language:
        chosen += rows[: max(1, landmarks // len(languages))]
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
    model = Model(languages, vocabulary, np.zeros((len(vocabulary), len(chosen)), np.float32), np.empty(0))
    place = model._places()
    for column, i in enumerate(chosen):
        model.landmarks[place[sets[i]], column] = 1 / np.sqrt(max(1, len(sets[i])))
    k = np.concatenate([model.kernel(sets[i : i + SCORED]) for i in range(0, len(sets), SCORED)]).astype(float)
    m = k[chosen]
    y = np.zeros((len(labels), len(languages)))
    y[np.arange(len(labels)), own] = 1
    # each language counts alike, however many rows the sample holds of it
    weight = 1 / np.maximum(1, y.sum(axis=0))[y.argmax(axis=1)]
    left = (k * weight[:, None]).T @ k + ridge * len(languages) * ((m + m.T) / 2) / len(chosen)
    left += 1e-6 * np.trace(left) / len(chosen) * np.eye(len(chosen))
    model.weights = np.linalg.solve(left, (k * weight[:, None]).T @ y).astype(np.float32)
    return model


def fit(
    docs: DataFrame, label: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE
) -> Model | None:
    """A classifier learned from a sample of the rows that have a text and a label; None if there is none."""
    rows = docs.select(
        F.col(label).cast("string").alias("label"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("doc_id"), F.col("text")).alias("h"),
    ).filter("label IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    if not counts:
        return None
    each = max(LEAST, sample // len(counts))
    shares = [(r["label"], min(1.0, each / r["n"]), r["least"]) for r in counts]
    shares = docs.sparkSession.createDataFrame(shares, "label string, share double, least long")
    # one row at least of each label
    taken_by_hash = (F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < F.col("share")) | (F.col("h") == F.col("least"))
    part = rows.join(F.broadcast(shares), "label").filter(taken_by_hash).select("label", "text", "h")

    def worker():
        presence = Presence()
        return lambda columns: [
            [np.sort(presence.distinct(t.as_py())).astype("<i4").tobytes() for t in columns[0]]
        ]

    grams = T.StructType().add("grams", "binary")
    taken: pd.DataFrame = with_columns_in_arrow(part, [F.col("text")], grams, worker, drop=("text",)).toPandas()
    taken = taken.sort_values(["label", "h"]).groupby("label").head(2 * each)
    sets = [np.frombuffer(g, dtype="<i4") for g in taken["grams"]]
    languages = sorted(set(taken["label"]))
    return _solve(languages, list(taken["label"]), sets, landmarks, ridge) if languages else None


def predict(
    docs: DataFrame, model: Model | None, drop: tuple[str, ...] = (), lettered: str | None = None
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1). Columns in ``drop`` are left out.

    A column named ``lettered``, if asked for, says whether the text holds a letter.
    """
    new = T.StructType().add("lang_pred", "string").add("score", "double")
    if lettered:
        new = new.add(lettered, "boolean")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def worker():
        presence, model = Presence(), sent.value

        def make(columns):
            n = len(columns[0])
            names, scores, letters = [UNKNOWN] * n, [0.0] * n, [False] * n
            at, sets = [], []

            def score() -> None:
                if sets:
                    values = model.scores(sets)
                    best = values.argmax(axis=1)
                    for i, b, v in zip(at, best.tolist(), values.max(axis=1).tolist(), strict=True):
                        names[i], scores[i] = model.languages[b], min(1.0, max(0.0, v))
                at.clear()
                sets.clear()

            for i, value in enumerate(columns[0]):
                text = value.as_py()
                letters[i] = bool(text and _LETTER.search(text))
                if model is not None and letters[i]:
                    at.append(i)
                    sets.append(presence.distinct(text))
                    if len(sets) == SCORED:
                        score()
            score()
            return [names, scores, letters] if lettered else [names, scores]

        return make

    return with_columns_in_arrow(docs, [docs["text"].cast("string")], new, worker, drop)


def held_out(doc_id: Column) -> Column:
    """Rows that a classifier is tested on: the CRC-32 of the id's digits leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, drop: tuple[str, ...] = (), lettered: str | None = None) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, learned from the rows that are not held out."""
    model = fit(docs.filter(~held_out(docs["doc_id"])))
    return predict(docs.withColumn("held_out", held_out(docs["doc_id"])), model, drop, lettered)
