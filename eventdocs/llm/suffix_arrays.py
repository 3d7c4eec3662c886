"""Suffix-array dedup of exact byte strings: induced sorting and permuted common prefixes, shard by shard.

Suffixes are classified as smaller or larger than their right neighbour. The leftmost-smaller substrings are sorted by
induction and named, their string is sorted recursively, and the order of all suffixes is induced from theirs. Small
alphabets are induced bucket by bucket in numpy, large ones (the names) in one plain linear loop.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventdocs.llm import repeats

LENGTH, GRAM = 100, 24
#: Bytes of a shard on average.
SHARD_BYTES = 1 << 20
#: Places of a string per symbol from which on buckets are large enough for numpy.
_BUCKET = 300


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its right neighbour; the last one, the sentinel, is."""
    n = len(text)
    differs = np.append(text[1:] != text[:-1], True)
    upcoming = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    out = np.ones(n, bool)
    inner = upcoming < n - 1
    out[inner] = text[upcoming[inner]] < text[upcoming[inner] + 1]
    return out


def _deal(heads: np.ndarray, symbols: np.ndarray, up: bool) -> np.ndarray:
    """Places for entries of these symbols in order, at the heads (or tails) of their buckets, which move on."""
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    counts = np.diff(np.append(starts, len(sorted_)))
    rank = np.arange(len(sorted_)) - np.repeat(starts, counts)
    where = np.empty(len(symbols), np.int64)
    own = sorted_[starts]
    where[order] = np.repeat(heads[own], counts) + (rank if up else -rank)
    heads[own] += counts if up else -counts
    return where


def _induce_by_bucket(text, smaller, size, ends, order):
    """All suffixes from the leftmost-smaller ones in ``order``, one bucket after another."""
    n = len(text)
    out = np.full(n, -1, np.int32)
    starts = ends - size
    tails = ends - 1
    reverse = order[::-1]
    out[_deal(tails, text[reverse], False)] = reverse
    sources = [out[t + 1 : e] for t, e in zip(tails, ends)]
    sources = [s.copy() for s in sources]
    heads = starts.copy()

    def send(entries, up, lines):
        before = entries[entries > 0] - 1
        before = before[smaller[before] != up]
        if len(before):
            out[_deal(lines, text[before], up)] = before

    present = np.flatnonzero(size)
    for c in present:
        done = starts[c]
        while done < heads[c]:
            upto = heads[c]
            send(out[done:upto], True, heads)
            done = upto
        if len(sources[c]):
            send(sources[c], True, heads)
    tails = ends - 1
    for c in present[::-1]:
        done = ends[c]
        while True:
            upto = tails[c] + 1
            if upto >= done:
                break
            send(out[upto:done][::-1], False, tails)
            done = upto
        low, high = starts[c], heads[c]
        if high > low:
            send(out[low:high][::-1], False, tails)
    out[0] = n - 1
    return out


def _induce_by_place(text, smaller, size, ends, order):
    """The same in plain loops, for strings with many symbols. An empty place holds 0, which induces nothing."""
    n = len(text)
    out = [0] * n
    before = np.append(-1, text[:-1].astype(np.int64))  # the symbol on the left, where it is of the pass's class
    larger = np.append(False, ~smaller[:-1])
    tails = ends - 1
    reverse = order[::-1]
    for place, i in zip(_deal(tails, text[reverse], False).tolist(), reverse.tolist()):
        out[place] = i
    lines, left = (ends - size).tolist(), np.where(larger, before, -1).tolist()
    for i in out:
        c = left[i]
        if c >= 0:
            place = lines[c]
            out[place] = i - 1
            lines[c] = place + 1
    lines, left = (ends - 1).tolist(), np.where(larger, -1, before).tolist()
    for i in reversed(out):
        c = left[i]
        if c >= 0:
            place = lines[c]
            out[place] = i - 1
            lines[c] = place - 1
    out[0] = n - 1
    return np.fromiter(out, np.int32, n)


def _names(text: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings in ``order``; equal ones share a rank. ends[i]: where that at i ends."""
    a, b = order[:-1], order[1:]
    size = ends[a] - a
    same = size == ends[b] - b
    live = np.flatnonzero(same)
    depth = 0
    while len(live):
        equal = text[a[live] + depth] == text[b[live] + depth]
        same[live[~equal]] = False
        live = live[equal]
        live = live[size[live] > depth]
        depth += 1
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text``, whose last symbol is 0 and smaller than all others."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    size = np.bincount(text)
    ends = np.cumsum(size)
    smaller = _smaller(text)
    first = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _induce_by_bucket if n >= _BUCKET * len(size) else _induce_by_place
    sorted_ = induce(text, smaller, size, ends, first)
    is_first = np.zeros(n, bool)
    is_first[first] = True
    order = sorted_[is_first[sorted_]].astype(np.int64)
    stop = np.zeros(n, np.int64)
    stop[first] = np.append(first[1:], n - 1)
    name = np.zeros(n, np.int64)
    ranks = _names(text, order, stop)
    name[order] = ranks
    if ranks[-1] + 1 < len(first):
        order = first[suffix_array(name[first])]
    else:
        return induce(text, smaller, size, ends, order)
    return induce(text, smaller, size, ends, order)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each place the length it shares with the suffix before it in ``order``.

    Only places whose left neighbours differ are compared, eight symbols at a time; from one to the next the value falls
    by one per place. ``text`` is an array of bytes.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    left = np.where(place > 0, text[place - 1].astype(np.int16), -1)
    other = np.where(before > 0, text[before - 1].astype(np.int16), -2)
    start = np.flatnonzero((left != other) | (before < 0))
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    padded[n : n + 8] = 0
    blocks = np.ndarray((n,), "<u8", padded, strides=(1,))
    size = np.zeros(len(start), np.int64)
    live = np.flatnonzero(before[start] >= 0)
    while len(live):
        a, b = start[live] + size[live], before[start[live]] + size[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        differ = blocks[a] ^ blocks[b]
        # The lowest differing byte of eight.
        lowest = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.bitwise_count(lowest - np.uint64(1)) >> 3).astype(np.int64))
        size[live] += same
        live = live[same == 8]
    reach = np.zeros(n, np.int64)
    reach[start] = start + size
    return np.minimum(np.maximum.accumulate(reach) - place, n - place)


def _repeated(contents: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """Stretches of the contents covered by a string of ``length`` bytes that starts earlier too."""
    # UTF-8 has no byte over 0xF4, so two symbols are free: 0 ends the shard, 1 ends a content.
    text = np.frombuffer(b"".join(c + b"\xff" for c in contents) + b"\xfe", np.uint8) + np.uint8(2)
    ends = np.cumsum([len(c) + 1 for c in contents])
    order = suffix_array(text).astype(np.int64)
    shared = common_prefixes(text, order)[order]
    starts = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(contents)), np.diff(np.append(starts, ends[-1])))
    n = len(text)
    window = np.zeros(n, bool)
    window[: n - 1] = np.arange(n - 1) + length < ends[owner]
    groups = np.flatnonzero(shared < length)
    places = np.where(window[order], order, n)
    earliest = np.minimum.reduceat(places, groups)
    again = np.zeros(n, bool)
    group = np.repeat(np.arange(len(groups)), np.diff(np.append(groups, n)))
    again[order] = window[order] & (order > earliest[group])
    # Neighbouring windows make one stretch; windows of two contents are never neighbours.
    edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
    out: list[list] = [[] for _ in contents]
    for a, b in edge.reshape(-1, 2).tolist():
        own = owner[a]
        out[own].append((a - starts[own], b - 1 + length - starts[own]))
    return [np.array(o, np.int64).reshape(-1, 2) for o in out]


_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)


def _symbols(text: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(text, np.uint8)]


def _content(text: bytes):
    return lambda a, b: text[a:b]


def _without(text: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    edges = [0, *spans.ravel().tolist(), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return kept, len(text), len(text) - len(kept)


def kind(length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> repeats.Kind:
    gram = max(1, min(gram, length))
    return repeats.Kind(_symbols, _content, length, gram, True, 1, _repeated, shard_bytes)


def dedup_substrings(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, kept, n_bytes, n_removed, spans) of every row.

    A text is its UTF-8 bytes (null: none). Every byte goes that a string of ``length`` bytes covers which also starts
    earlier: in a document with a smaller key, or further left in the same; all strings are those of the input. ``kept`` is
    what is left, ``spans`` the maximal stretches that went. Rows with equal key and text are one document, and each gets its
    result; of one key's different texts the order is arbitrary but fixed; null keys come last. Shorter texts are
    unchanged; an empty table gives an empty one; other columns are not read.
    """
    return repeats.cut_out(docs, key, kind(length, shard_bytes=shard_bytes), _without).select(
        key, "kept", F.col("total").alias("n_bytes"), F.col("removed").alias("n_removed"), "spans"
    )
