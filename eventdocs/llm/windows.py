"""Windows of a fixed length that may repeat, routed by content.

Every window of ``length`` symbols has a key: the smallest hash of its grams. Equal windows have equal keys, so windows
whose key occurs once are unique, and the others need to be compared only within their key. Neighbouring windows mostly
share their key, so a document is a sequence of runs: (first window, number of windows, key, hash of the content).
"""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64(0xFFFF)
#: Windows of a run at most; a longer run is cut, which changes no result.
MOST_WINDOWS = 127


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        size = 1 << (n - 1).bit_length()
        _tables[0], _tables[1] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables[0], _tables[1]


class Hashes:
    """Hashes of any stretch of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        self.up, self.down = _power_tables(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.up[: len(symbols)], out=self.sums[1:])

    def grams(self, size: int) -> np.ndarray:
        """The hash of every ``size`` neighbours; the low 16 bits are those of its place."""
        n = len(self.sums) - size
        found = self.sums[size:] - self.sums[:n]
        found *= self.down[:n]
        found ^= found >> np.uint64(32)
        found *= _A
        found ^= found >> np.uint64(29)
        found &= ~_PLACE
        found |= np.arange(n, dtype=np.uint64) & _PLACE
        return found

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + size * _B)


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling."""
    span, out = 1, grams
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def runs(symbols: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(owner, first, windows, key, content, again) of the runs of several documents laid end to end.

    ``ends`` says where each document ends; ``first`` counts from its start. A run's windows share key and place of the
    smallest gram; of equal grams the place's low bits decide. ``again`` marks the rare runs where these wrap around, so
    that two equal windows might be in the same run; other equal windows are in two runs with the same key.
    """
    n = len(symbols)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, bool))
    hashes = Hashes(symbols)
    width = length - gram + 1
    least = _least(hashes.grams(gram), width)
    starts = np.concatenate([[0], ends[:-1]])
    cut = np.empty(len(least), bool)
    cut[0] = True
    np.not_equal(least[1:], least[:-1], out=cut[1:])
    # Windows that would reach over a document's end are runs of their own, to be left out.
    whole = np.ones(len(least) + 1, bool)
    for a, b in zip(np.maximum(starts, ends - length + 1).tolist(), ends.tolist()):
        whole[a : b] = False
    inner = ends[:-1]
    cut[inner[inner < len(cut)]] = True
    over = np.maximum(starts, ends - length + 1)
    cut[over[over < len(cut)]] = True
    every = np.flatnonzero(cut)
    size = np.diff(np.append(every, len(least)))
    kept = whole[every]
    first, size = every[kept], size[kept]
    if len(size) and size.max() > MOST_WINDOWS:
        pieces = -(-size // MOST_WINDOWS)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + within * MOST_WINDOWS
        size = np.minimum(np.repeat(size, pieces) - within * MOST_WINDOWS, MOST_WINDOWS)
    content = hashes.of(first, first + size + length - 1)
    value = least[first]
    owner = np.searchsorted(ends, first, "right")
    again = (value & _PLACE) < np.uint64(2 * length)
    return owner, first - starts[owner], size, (value >> np.uint64(16)).view(np.int64), content.view(np.int64), again
