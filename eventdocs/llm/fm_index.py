"""Substring dedup of word windows: a compressed FM-index per shard and backward search.

A shard's contents are one string of word numbers. Its index is the Burrows-Wheeler transform as a wavelet matrix of packed
bits with counts, and the number of copies before each place of the suffix order. The contents are then streamed against it:
backward search extends a stretch to the left as long as it occurs at least twice, copies counted, which gives the matching
statistic at its right end, and intervals of at least the threshold are reported.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventdocs.llm import repeats
from eventdocs.llm.common import keeps

LENGTH, GRAM = 35, 8
#: Words of a shard on average.
SHARD_WORDS = 400_000
_CACHED_WORDS, _CACHED_BYTES = 500_000, 100
_END, _APART = 0, 1  # the shard's end, and the end of a content


class PackedBits:
    """A bit sequence in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, upto: np.ndarray) -> np.ndarray:
        word = upto >> 6
        low = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Counts of a symbol before any place, one packed bit sequence per bit of the symbols."""

    def __init__(self, symbols: np.ndarray):
        self.levels = []
        for bit in range(max(1, int(symbols.max()).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append((bit, PackedBits(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def place(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Where the last level has gone with the first ``upto`` places; differences are counts of the symbol."""
        for bit, bits, zeros in self.levels:
            ones = bits.ones(upto)
            upto = np.where((symbol >> bit) & 1 == 1, zeros + ones, upto - ones)
        return upto


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, which is all that backward search of ``depth`` steps needs."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    span = 1
    while True:
        beyond = np.zeros(len(text), np.int64)
        if span < len(text):
            beyond[:-span] = rank[span:] + 1
        pair = rank * (int(rank.max()) + 2) + beyond
        order = np.argsort(pair, kind="stable")
        step = np.append(False, pair[order][1:] != pair[order][:-1])
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(step)
        span *= 2
        if span >= depth or rank.max() == len(text) - 1:
            return order


class FMIndex:
    def __init__(self, text: np.ndarray, weights: np.ndarray, depth: int):
        order = suffix_order(text, depth)
        self.matrix = WaveletMatrix(text[order - 1])
        symbols = np.arange(int(text.max()) + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(symbols)))])
        self.base = self.matrix.place(symbols, np.zeros(len(symbols), np.int64))
        self.copies = np.concatenate([[0], np.cumsum(weights[order])])
        self.size = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffix order after one symbol more on the left."""
        start = self.first[symbol] - self.base[symbol]
        both = self.matrix.place(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return start + both[: len(symbol)], start + both[len(symbol) :]

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.where(high > low, self.copies[high] - self.copies[low], 0)

    def reach(self, text: np.ndarray, stop: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For stretches that end before ``end`` the leftmost start, not under ``stop``, from which they occur twice."""
        start = end.copy()
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.size, np.int64)
        live = np.flatnonzero(start > stop)
        while len(live):
            low[live], high[live] = self.extend(text[start[live] - 1], low[live], high[live])
            live = live[self.occurrences(low[live], high[live]) >= 2]
            start[live] -= 1
            live = live[start[live] > stop[live]]
        return start


def _repeated(contents: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """Stretches of the contents covered by windows of ``length`` words that occur twice, copies counted.

    For each content a..b are the windows not decided yet. Search from the end of window b decides b and all windows that
    the stretch found covers. Search from the end of window a either finds it, or a word where it fails: no window that
    covers the failing stretch occurs twice, so all up to that word are decided. The two alternate.
    """
    sizes = np.array([len(c) // 8 for c in contents])
    words = np.frombuffer(b"".join(contents), "<u8")
    known, number = np.unique(words, return_inverse=True)
    text = np.full(len(words) + len(contents) + 1, _APART, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    owner = np.repeat(np.arange(len(contents)), sizes)
    text[np.arange(len(words)) + owner] = number + 2
    text[-1] = _END
    weights = np.zeros(len(text), np.int64)
    weights[np.arange(len(words)) + owner] = copies[owner]
    index = FMIndex(text, weights, int(sizes.max()) + 1)
    hit = np.zeros(len(text) + 1, bool)
    a, b = starts.copy(), ends - length
    own = np.flatnonzero(a <= b)
    while len(own):
        found = index.reach(text, a[own], b[own] + length)
        full = b[own] + length - found >= length
        covered = np.where(full, found, b[own] + 1)
        _mark(hit, covered, b[own])
        b[own] = np.where(full, np.minimum(found, b[own]) - 1, b[own] - 1)
        own = own[a[own] <= b[own]]
        if not len(own):
            break
        found = index.reach(text, a[own], a[own] + length)
        full = found <= a[own]
        _mark(hit, a[own][full], a[own][full])
        a[own] = np.where(full, a[own] + 1, found)
        own = own[a[own] <= b[own]]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
    out: list[list] = [[] for _ in contents]
    for x, y in edge.tolist():
        i = int(np.searchsorted(ends, x, "right"))
        out[i].append((x - starts[i], y - 1 + length - starts[i]))
    return [np.array(o, np.int64).reshape(-1, 2) for o in out]


def _mark(hit: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
    """Sets hit[first..last] for each pair; nothing where first > last."""
    size = np.maximum(last - first + 1, 0)
    hit[np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = True


class _Words(dict):
    """Hash of a word, kept while the table is small."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _CACHED_BYTES:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = found
        return found


_words = _Words()
keeps("repeats", _words.clear)


def _symbols(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _content(text: bytes):
    words = text.split()
    return lambda a, b: np.fromiter(map(_words.__getitem__, words[a:b]), "<u8", b - a).tobytes()


def _without(text: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    words = text.split()
    edges = [0, *spans.ravel().tolist(), len(words)]
    kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
    return b" ".join(kept), len(words), len(words) - len(kept)


def kind(length: int = LENGTH, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> repeats.Kind:
    gram = max(1, min(gram, length))
    return repeats.Kind(_symbols, _content, length, gram, False, 8, _repeated, shard_words)


def dedup_windows(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key, kept, n_words, n_removed, spans) of every row.

    Words are the unchanged runs of other characters than ASCII white space. Every word goes that a window of ``length``
    words of one row covers whose sequence also starts anywhere else, in the same row or another; all copies go, and windows
    are those of the input. ``kept`` is the words left, joined by one space, ``spans`` the maximal stretches of words that
    went. A null text has no words. Repeated rows are copies of each other; null keys are kept. Shorter texts only lose
    their spacing; an empty table gives an empty one; other columns are not read.

    Words are compared by their 64-bit hashes.
    """
    return repeats.cut_out(docs, key, kind(length, shard_words=shard_words), _without).select(
        key, "kept", F.col("total").alias("n_words"), F.col("removed").alias("n_removed"), "spans"
    )
