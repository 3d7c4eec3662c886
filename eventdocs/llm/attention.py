"""A small causal self-attention model of subword ids, in numpy.

A step's input is the id before it. Queries, keys and values of its window, and the input itself, go to classes of ids: the
most frequent ids are classes of their own, others are grouped by what stands before them. Within its class an id has
the share of its count, so probabilities of all ids add up to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Inputs of a window, and its last ones that are scored where an earlier window has scored those before them.
WINDOW, STRIDE = 40, 32
DEPTH = 16
#: Ids that are classes of their own, groups of others, ids with an input vector of their own.
ALONE, GROUPS, KNOWN = 71, 24, 2048
CLASSES = ALONE + GROUPS + 1
NAMES = ("inputs", "places", "q", "k", "v", "out")


@dataclass(frozen=True)
class Vocabulary:
    """Class, input row and log10 of the share within its class, of every id; the last row is the start of a text."""

    of_class: np.ndarray
    row: np.ndarray
    share: np.ndarray
    #: Natural logarithm of the share of each class.
    classes: np.ndarray

    @property
    def start(self) -> int:
        return len(self.of_class)


def ranked(counts: np.ndarray) -> np.ndarray:
    """Ids by falling count, of equal counts the smaller first."""
    return np.argsort(-counts, kind="stable")


def pairs(windows: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """How often each of the KNOWN most frequent ids follows each of the ALONE most frequent ones, directly or one id later."""
    rank = np.full(size + 1, KNOWN)
    rank[order[:KNOWN]] = np.arange(min(KNOWN, len(order)))
    r = rank[np.clip(windows, 0, size)]
    total = np.zeros((KNOWN, ALONE), np.int64)
    for gap in (1, 2):
        before, after = r[:, :-gap].ravel(), r[:, gap:].ravel()
        both = (before < ALONE) & (after < KNOWN)
        total += np.bincount(after[both] * ALONE + before[both], minlength=KNOWN * ALONE).reshape(KNOWN, ALONE)
    return total


def _grouped(points: np.ndarray, groups: int, rounds: int = 20) -> np.ndarray:
    """k-means of unit vectors from evenly spread starts."""
    centres = points[np.linspace(0, len(points) - 1, min(groups, len(points))).astype(int)]
    for _ in range(rounds):
        nearest = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return (points @ centres.T).argmax(1)


def vocabulary(counts: np.ndarray, followed: np.ndarray) -> Vocabulary:
    """From counts of all ids, and from ``pairs``. Ids that are not among the KNOWN most frequent ones share a class."""
    order = ranked(counts)
    of_class = np.full(len(counts), CLASSES - 1)
    top = order[: min(KNOWN, len(order))]
    of_class[top[:ALONE]] = np.arange(len(top[:ALONE]))
    seen = counts[top[ALONE:]] > 0
    others = top[ALONE:][seen]
    if len(others):
        points = np.sqrt(followed[ALONE : ALONE + len(top[ALONE:])][seen] + 0.01)
        of_class[others] = ALONE + _grouped(points / np.linalg.norm(points, axis=1, keepdims=True), GROUPS)
    row = KNOWN + of_class
    row[top] = np.arange(len(top))
    weight = counts + 0.5
    by_class = np.bincount(of_class, weight, CLASSES)
    share = np.log10(weight) - np.log10(by_class[of_class])
    classes = np.log((by_class + 1e-9) / (by_class + 1e-9).sum())
    return Vocabulary(of_class.astype(np.int16), np.append(row, KNOWN + CLASSES).astype(np.int16), share, classes)


def initial(words: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights before training: every context gives the classes their share."""
    rng = np.random.default_rng(seed)
    shapes = {"inputs": (KNOWN + CLASSES + 1, DEPTH), "places": (WINDOW, DEPTH), "q": (DEPTH, DEPTH), "k": (DEPTH, DEPTH),
              "v": (DEPTH, DEPTH), "out": (2 * DEPTH + 1, CLASSES)}
    scale = {"inputs": 0.3, "places": 0.1, "q": 0.25, "k": 0.25, "v": 0.25, "out": 0.05}
    weights = {n: (rng.normal(0, scale[n], s)).astype(np.float32) for n, s in shapes.items()}
    weights["out"][-1] = words.classes
    return weights


_LATER = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def _attention(q: np.ndarray, k: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Unnormalized attention of every input to itself and those before it. Scores are kept from overflowing."""
    a = np.matmul(q, k.transpose(0, 2, 1), out=out)
    np.clip(a, -30, 30, out=a)
    np.exp(a, out=a)
    a *= _LATER[WINDOW - a.shape[1] :]
    return a


class Scorer:
    """Scores windows; what inputs and places give to queries, keys, values and classes is laid out in tables once, and
    arrays of a block of windows are kept for the next one."""

    def __init__(self, weights: dict[str, np.ndarray], words: Vocabulary):
        w, self.words = weights, words
        # The last column adds up the attention, as a value of 1 would.
        wide = np.hstack([w["q"], w["k"], np.eye(DEPTH, dtype=np.float32), w["v"], np.zeros((DEPTH, 1), np.float32)])
        self.table = np.ascontiguousarray(w["inputs"] @ wide)
        self.places = w["places"] @ wide
        self.places[:, -1] = 1
        self.out = w["out"]
        self.ones = np.ones(CLASSES, np.float32)
        self.kept: dict[tuple[str, tuple[int, ...]], np.ndarray] = {}

    def _array(self, name: str, *shape: int) -> np.ndarray:
        if (name, shape) not in self.kept:
            self.kept = {k: v for k, v in self.kept.items() if k[0] != name}
            self.kept[name, shape] = np.ones(shape, np.float32)
        return self.kept[name, shape]

    def logs(self, rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of ``targets`` (window, last ones), given input rows (window, WINDOW)."""
        n, last = targets.shape
        d = DEPTH
        x = self._array("x", n, WINDOW, 4 * d + 1)
        np.take(self.table, rows, axis=0, out=x, mode="clip")
        x += self.places
        a = _attention(x[:, WINDOW - last :, :d], x[:, :, d : 2 * d], self._array("a", n, last, WINDOW))
        summed = np.matmul(a, x[:, :, 3 * d :], out=self._array("summed", n, last, d + 1))
        hidden = self._array("hidden", n, last, 2 * d + 1)
        hidden[:, :, :d] = x[:, WINDOW - last :, 2 * d : 3 * d]
        np.divide(summed[:, :, :d], summed[:, :, d:], out=hidden[:, :, d : 2 * d])
        z = np.matmul(hidden.reshape(n * last, -1), self.out, out=self._array("z", n * last, CLASSES))
        right = z[np.arange(len(z)), targets.ravel()]
        np.exp(z, out=z)
        return right - np.log(z @ self.ones)


def gradients(w: dict[str, np.ndarray], rows: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the target classes of whole windows, and its gradients. Targets below 0 don't count."""
    n, d, size = len(rows), DEPTH, rows.size
    x = w["inputs"][rows] + w["places"]
    q, k, v = x @ w["q"], x @ w["k"], x @ w["v"]
    a = _attention(q, k)
    a /= a.sum(2, keepdims=True)
    o = a @ v
    hidden = np.concatenate([x, o, np.ones((n, WINDOW, 1), np.float32)], 2).reshape(size, -1)
    z = hidden @ w["out"]
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    real = np.flatnonzero(targets.ravel() >= 0)
    at = (real, targets.ravel()[real])
    loss = -float(np.log(z[at] + 1e-30).sum()) / max(1, len(real))
    z[at] -= 1
    z[targets.ravel() < 0] = 0
    z /= max(1, len(real))
    g = {"out": hidden.T @ z}
    back = (z @ w["out"].T).reshape(n, WINDOW, -1)
    dx, do = back[:, :, :d].copy(), back[:, :, d : 2 * d]
    dv = a.transpose(0, 2, 1) @ do
    da = do @ v.transpose(0, 2, 1)
    da = a * (da - (da * a).sum(2, keepdims=True))
    dq, dk = da @ k, da.transpose(0, 2, 1) @ q
    for name, own in (("q", dq), ("k", dk), ("v", dv)):
        g[name] = x.reshape(size, d).T @ own.reshape(size, d)
        dx += own @ w[name].T
    g["places"] = dx.sum(0)
    g["inputs"] = np.zeros_like(w["inputs"])
    np.add.at(g["inputs"], rows.ravel(), dx.reshape(size, d))
    return loss, g


def train(
    w: dict[str, np.ndarray], rows: np.ndarray, targets: np.ndarray, first: int, steps: int, rate: float, batch: int = 128
) -> dict[str, np.ndarray]:
    """The weights after ``steps`` Adam steps over the windows in turn, from batch ``first`` on."""
    w = {n: a.copy() for n, a in w.items()}
    mean = {n: np.zeros_like(a) for n, a in w.items()}
    square = {n: np.zeros_like(a) for n, a in w.items()}
    for step in range(1, steps + 1):
        at = (first + step - 1) * batch
        own = np.arange(at, at + batch) % len(rows) if len(rows) > batch else np.arange(len(rows))
        _, found = gradients(w, rows[own], targets[own])
        for n, g in found.items():
            mean[n] += 0.1 * (g - mean[n])
            square[n] += 0.02 * (g * g - square[n])
            change = mean[n] / (1 - 0.9**step) / (np.sqrt(square[n] / (1 - 0.98**step)) + 1e-8)
            w[n] -= rate * change
    return w


def packed(weights: dict[str, np.ndarray]) -> bytes:
    return b"".join(weights[n].astype("<f8").tobytes() for n in NAMES)


def unpacked(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n in NAMES:
        out[n] = values[at : at + like[n].size].reshape(like[n].shape).astype(np.float32)
        at += like[n].size
    return out
