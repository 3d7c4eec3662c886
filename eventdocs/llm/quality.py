"""Quality: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features gives a document's place on a line, ordered thresholds cut the line into
grades: P(grade > k) = sigmoid(place - threshold k). The expected grade and the probability of at least a wanted grade
follow from it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventdocs.llm.common import keeps
from eventdocs.llm.labelled import BUCKETS, SAMPLE_ROWS, HashedWords, sample, scored

#: Grades of the given labels: low quality, good but toxic, good.
GRADES = 3
#: Training steps that a small sample gets at least.
LEAST_STEPS = 600
_LETTERS, _UPPER, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), re.compile(r"\d+")
_tables: dict[str, dict] = {}
keeps("words", _tables.clear)


class HashedShapes(HashedWords):
    """Bucket of a word's shape: runs of letters, capitals and digits count as one character each."""

    def value(self, word: bytes) -> int:
        shape = _LETTERS.sub("a", _UPPER.sub("\x01", _DIGITS.sub("0", word.decode())))
        return 1 + xxhash.xxh32_intdigest(shape.encode(), 1) % (self.buckets - 1)


def _table(kind: type, buckets: int) -> HashedWords:
    """The worker's own table."""
    own = _tables.setdefault(kind.__name__, {})
    return own.setdefault(buckets, kind(buckets))


def _marks(text: bytes, words: list[bytes], buckets: int) -> list[int]:
    """Features of the whole document: its size, and how much of its words and lines repeats, in steps."""
    lines = text.split(b"\n")
    share = lambda part, whole: int(10 * part / whole) if whole else -1
    facts = [
        ("words", len(words).bit_length()),
        ("distinct words", share(len(set(words)), len(words)), min(8, len(words).bit_length())),
        ("distinct lines", share(len(set(lines)), len(lines))),
        ("line", (len(text) // len(lines)).bit_length()),
        ("word", (len(text) // (len(words) + 1))),
    ]
    return [1 + xxhash.xxh32_intdigest(repr(f).encode(), 2) % (buckets - 1) for f in facts]


def features(texts: Sequence[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, document) triples. Words and shapes share the weight of a document; every mark has its own."""
    words_of, shapes_of = _table(HashedWords, buckets), _table(HashedShapes, buckets)
    ids, values, owners = [], [], []
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        marks = np.array(_marks(text, words, buckets), np.int32)
        ids += [words_of.of(words), shapes_of.of(words) + buckets, marks + 2 * buckets]
        values += [np.full(2 * n, 4 / max(n, 1), np.float32), np.full(len(marks), 0.5, np.float32)]
        owners.append(np.full(2 * n + len(marks), i, np.int32))
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int32)
    return np.concatenate(ids), np.concatenate(values), np.concatenate(owners)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.weights) // 3

    def tails(self, texts: Sequence[bytes]) -> np.ndarray:
        """P(grade > k) for every text and k; falls as k rises."""
        ids, values, owners = features(texts, self.buckets)
        place = np.bincount(owners, self.weights[ids] * values, minlength=len(texts))
        return _sigmoid(place[:, None] - self.thresholds[None, :])


def fit(rows: Sequence[tuple[int, str]], grades: int = GRADES, buckets: int = BUCKETS, epochs: int = 15) -> OrdinalModel:
    """A model of rows (grade, text), by Adagrad on the log likelihood in batches of 64.

    Thresholds start at the grades' smoothed frequencies and stay in order. Without rows, all grades are equally likely.
    """
    rng = np.random.default_rng(0)
    weights = np.zeros(3 * buckets, np.float64)
    grade = np.array([r[0] for r in rows], int)
    tail = (np.array([(grade > k).sum() for k in range(grades - 1)]) + (grades - 1 - np.arange(grades - 1)) / grades)
    tail = tail / (len(rows) + 1)
    cut = -np.log(tail / (1 - tail))
    if not rows:
        return OrdinalModel(weights, cut)
    parts = [features([r[1].encode()], buckets)[:2] for r in rows]
    parts = [_summed(ids, values) for ids, values in parts]
    squares, cut_squares, rate = np.full(len(weights), 1e-4), np.full(len(cut), 1.0), 0.1
    for _ in range(max(epochs, -(-LEAST_STEPS * 64 // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            ids = np.concatenate([parts[i][0] for i in own])
            values = np.concatenate([parts[i][1] for i in own])
            owners = np.repeat(np.arange(len(own)), [len(parts[i][0]) for i in own])
            place = np.bincount(owners, weights[ids] * values, minlength=len(own))
            above = np.concatenate([np.ones((len(own), 1)), _sigmoid(place[:, None] - cut), np.zeros((len(own), 1))], 1)
            y, pick = grade[own], np.arange(len(own))
            high, low = above[pick, y], above[pick, y + 1]
            chance = np.maximum(high - low, 1e-9)
            d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
            slope = -(d_high - d_low) / len(own)
            g_cut = np.zeros(len(cut))
            np.add.at(g_cut, y[y > 0] - 1, d_high[y > 0] / len(own))
            np.add.at(g_cut, y[y < len(cut)], -d_low[y < len(cut)] / len(own))
            g = np.bincount(ids, values * slope[owners], minlength=len(weights))
            squares += g * g
            weights -= rate * g / np.sqrt(squares)
            cut_squares += g_cut * g_cut
            cut = np.maximum.accumulate(cut - rate * g_cut / np.sqrt(cut_squares) + 1e-3 * np.arange(len(cut)))
            cut -= 1e-3 * np.arange(len(cut))
    return OrdinalModel(weights, np.maximum.accumulate(cut))


def _summed(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(ids, return_inverse=True)
    return distinct, np.bincount(back, values, minlength=len(distinct))


def grade_of_labels() -> Column:
    """0 for low quality, 1 for good quality but toxic, 2 for good quality."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def fit_on_tables(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """A model fitted on at most ``rows`` labelled rows of each grade outside the held-out fold."""
    model = fit(sample(docs, labels, grade_of_labels(), key, rows))
    _tables.clear()
    return model


def grades(
    docs: DataFrame, model: OrdinalModel, key: str = "doc_id", least: int = 1, sure: float = 0.5
) -> DataFrame:
    """(key, expected_grade, tail_probability, grade, selected) of every row over its whole text.

    ``tail_probability`` is that of a grade of at least ``least``, ``grade`` the most likely one, ``selected`` whether the tail
    reaches ``sure``. A null or empty text is graded as a text without words. Repeated rows and null keys are kept; an
    empty table gives an empty one; other columns are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[bytes]) -> list[np.ndarray]:
        tails = shared.value.tails(texts)
        chances = -np.diff(np.concatenate([np.ones((len(texts), 1)), tails, np.zeros((len(texts), 1))], 1), axis=1)
        return [tails.sum(1), tails[:, least - 1], chances.argmax(1)]

    found = scored(docs, key, score, ["expected_grade", "tail_probability", "grade"])
    return found.withColumn("grade", F.col("grade").cast("int")).withColumn(
        "selected", F.col("tail_probability") >= sure
    )
