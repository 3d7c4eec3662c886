"""Toxicity: a convolutional text classifier, trained in numpy on a bounded sample of labelled rows.

Hashed word embeddings go through filters of several widths, each filter keeps its largest value over the whole text, and
a logistic layer turns those into a score, calibrated on rows left out of training. For decisions, every language
has its own threshold, calibrated on the same rows; the language is no input of the score.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventdocs.llm.common import keeps
from eventdocs.llm.labelled import BUCKETS, SAMPLE_ROWS, HashedWords, sample, scored

WIDTHS, FILTERS, DEPTH = (1, 2, 3), 12, 12
THRESHOLD = 0.7
#: Rows of a language that its own threshold needs; with fewer, the common one holds.
LEAST_OF_LANGUAGE = 30
#: Documents of the sample that must hold a word for it to get an embedding; the others' stay zero.
LEAST_DOCS = 5
#: Share of the words that a training step leaves out.
DROPPED = 0.6
_hashed: dict[int, HashedWords] = {}
keeps("words", _hashed.clear)


def hashed_words(buckets: int) -> HashedWords:
    """The worker's own table of words."""
    return _hashed.setdefault(buckets, HashedWords(buckets))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _layout(docs: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets of all documents with zeros between them, and where each starts and ends; an empty one is one zero."""
    gap = np.zeros(max(WIDTHS) - 1, np.int32)
    docs = [d if len(d) else np.zeros(1, np.int32) for d in docs]
    flat = np.concatenate([x for d in docs for x in (d, gap)])
    sizes = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes + len(gap))[:-1]])
    return flat, starts, starts + sizes


@dataclass
class Network:
    words: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = THRESHOLD

    def filters(self, flat: np.ndarray) -> list[np.ndarray]:
        """For each width an array (filter, place): all filters' values at all places."""
        x = np.ascontiguousarray(self.words[flat].T)
        n = x.shape[1] - max(WIDTHS) + 1
        return [sum(k[i].T @ x[:, i : i + n] for i in range(w)) for w, k in zip(WIDTHS, self.kernels)]

    def pooled(self, docs: Sequence[np.ndarray]) -> np.ndarray:
        flat, starts, ends = _layout(docs)
        edges = np.stack([starts, ends], 1).ravel()[:-1]  # the last document ends where the values do
        tops = [np.maximum.reduceat(v, edges, axis=1)[:, ::2].T + b for v, b in zip(self.filters(flat), self.biases)]
        return np.maximum(np.concatenate(tops, 1), 0)

    def logits(self, docs: Sequence[np.ndarray]) -> np.ndarray:
        return self.pooled(docs) @ self.out + self.bias

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        table = hashed_words(len(self.words))
        raw = self.logits([table.of(t.split()) for t in texts])
        return _sigmoid(self.scale * raw.astype(float) + self.shift)


def _start(rng: np.random.Generator, buckets: int) -> Network:
    shape = lambda w: (w, DEPTH, FILTERS)
    return Network(
        np.zeros((buckets, DEPTH), np.float32),
        [rng.normal(0, 1 / np.sqrt(w * DEPTH), shape(w)).astype(np.float32) for w in WIDTHS],
        [np.full(FILTERS, 0.1, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )


def train(docs: Sequence[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, epochs: int = 24, seed: int = 0) -> Network:
    """Adagrad on the logistic loss in batches of 32. Both labels weigh the same."""
    rng = np.random.default_rng(seed)
    net = _start(rng, buckets)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    dense = [*net.kernels, *net.biases, net.out]
    squares = [np.full(p.shape, 1e-3, np.float32) for p in dense]
    holders = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=buckets)
    rare = holders < LEAST_DOCS
    word_squares, bias_square, rate = np.full(buckets, 1e-3, np.float32), 1e-3, 0.1

    def step(p, g, s):
        s += g * g
        p -= rate * g / np.sqrt(s)

    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), 32):
            own = order[at : at + 32]
            flat, starts, ends = _layout([docs[i] for i in own])
            # A share of the words is left out each time, so that a single telling word has to be enough.
            flat = np.where((rng.random(len(flat)) < DROPPED) | rare[flat], 0, flat)
            values = net.filters(flat)
            place = [np.stack([v[:, a:b].argmax(1) + a for a, b in zip(starts, ends)]) for v in values]
            tops = [np.take_along_axis(v, p.T, 1).T + b for v, p, b in zip(values, place, net.biases)]
            hidden = np.maximum(np.concatenate(tops, 1), 0)
            error = ((_sigmoid(hidden @ net.out + net.bias) - labels[own]) * weight[own] / len(own)).astype(np.float32)
            g_hidden = error[:, None] * net.out[None, :] * (hidden > 0)
            grads_k, grads_b, rows, row_grads = [], [], [], []
            for i, (w, p) in enumerate(zip(WIDTHS, place)):
                g = g_hidden[:, i * FILTERS : (i + 1) * FILTERS]
                g_kernel = np.empty_like(net.kernels[i])
                for k in range(w):
                    ids = flat[p + k]
                    g_kernel[k] = np.einsum("bf,bfd->df", g, net.words[ids])
                    rows.append(ids.ravel())
                    row_grads.append((g[:, :, None] * net.kernels[i][k].T[None]).reshape(-1, DEPTH))
                grads_k.append(g_kernel)
                grads_b.append(g.sum(0))
            ids, back = np.unique(np.concatenate(rows), return_inverse=True)
            g_words = np.zeros((len(ids), DEPTH), np.float32)
            np.add.at(g_words, back, np.concatenate(row_grads))
            g_words[ids == 0] = 0
            word_squares[ids] += (g_words**2).mean(1)
            net.words[ids] -= rate * g_words / np.sqrt(word_squares[ids])[:, None]
            for p, g, s in zip(dense, [*grads_k, *grads_b, hidden.T @ error], squares):
                step(p, g, s)
            bias_square += float(error.sum()) ** 2
            net.bias -= rate * float(error.sum()) / bias_square**0.5
    return net


def _calibrate(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve with smoothed targets, by Newton steps that are halved until they help."""
    positives = labels.sum()
    target = np.where(labels == 1, (positives + 1) / (positives + 2), 1 / (len(labels) - positives + 2))
    x = np.stack([raw, np.ones_like(raw)], 1)

    def loss(at):
        z = x @ at
        return float(np.sum(np.logaddexp(0, z) - target * z) + 1e-3 * (at @ at))

    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ at)
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 2e-3 * np.eye(2)
        move = np.linalg.solve(curve, x.T @ (p - target) + 2e-3 * at)
        while loss(at - move) > loss(at) and np.abs(move).max() > 1e-6:
            move = move / 2
        at = at - move
        if np.abs(move).max() <= 1e-6:
            break
    return float(max(at[0], 0.05)), float(at[1])


def _best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The highest F1 over the scores; the middle of the gap below it, within 0.3 and 0.9."""
    order = np.argsort(-scores)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(labels.sum(), 1))
    best = int(f1.argmax())
    below = scores[order[best + 1]] if best + 1 < len(order) else 0.0
    return float(np.clip((scores[order[best]] + below) / 2, 0.3, 0.9))


def fit(rows: Sequence[tuple[int, str, str | None]], buckets: int = BUCKETS, seed: int = 0) -> Network:
    """A network of rows (label, text, lang). A fifth of them calibrates score and thresholds.

    Without rows of both labels the score is the smoothed share of label 1 for every text.
    """
    table = hashed_words(buckets)
    labels = np.array([int(r[0]) for r in rows], float)
    if not len(rows) or labels.min() == labels.max():
        net = _start(np.random.default_rng(seed), buckets)
        share = (labels.sum() + 0.5) / (len(rows) + 1) if len(rows) else 0.01
        net.scale, net.shift = 0.0, float(np.log(share / (1 - share)))
        return net
    docs = [table.of(r[1].encode().split()) for r in rows]
    rng = np.random.default_rng(seed)
    kept = rng.random(len(rows)) < 0.8
    for label in (0, 1):  # both labels on both sides, as far as there are rows
        own = rng.permutation(np.flatnonzero(labels == label))
        kept[own[: max(1, int(0.8 * len(own)))]] = True
        kept[own[max(1, int(0.8 * len(own))) :]] = False
    learn, check = np.flatnonzero(kept), np.flatnonzero(~kept)
    net = train([docs[i] for i in learn], labels[learn], buckets, seed=seed)
    check = check if len(set(labels[check])) == 2 else np.arange(len(rows))
    raw = np.concatenate([net.logits([docs[i] for i in check[a : a + 64]]) for a in range(0, len(check), 64)]).astype(float)
    net.scale, net.shift = _calibrate(raw, labels[check])
    scores = _sigmoid(net.scale * raw + net.shift)
    net.common = _best_threshold(scores, labels[check])
    langs = np.array([rows[i][2] or "" for i in check])
    for lang in set(langs):
        own = langs == lang
        if own.sum() >= LEAST_OF_LANGUAGE and len(set(labels[check][own])) == 2:
            net.thresholds[lang] = _best_threshold(scores[own], labels[check][own])
    return net


def fit_on_tables(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Network:
    """A network fitted on at most ``rows`` labelled rows of each label outside the held-out fold."""
    found = sample(docs, labels, F.col("toxic").cast("int"), key, rows, extra=("lang",))
    net = fit([r for r in found if r[0] in (0, 1)])
    _hashed.clear()
    return net


def scores(docs: DataFrame, net: Network, key: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, *extra, score) of every row over its whole text: 0 to 1, higher is likelier toxic.

    A null or empty text has the score of a text without words. Repeated rows and null keys are kept; an empty table
    gives an empty one; other columns are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return scored(docs, key, lambda texts: [shared.value.score(texts)], ["score"], extra)


def rejected(net: Network, score: Column, lang: Column) -> Column:
    """Whether the score reaches the language's threshold (the common one for unknown and null languages)."""
    own = F.lit(net.common)
    for name, threshold in sorted(net.thresholds.items()):
        own = F.when(lang == name, threshold).otherwise(own)
    return score >= own
