"""Benchmark decontamination by the q-gram lemma.

A pattern of m characters that occurs in a text with at most k edits shares at least m + 1 - q(k + 1) q-grams with it, all
on k + 1 neighbouring diagonals. Shared q-grams are therefore counted in overlapping diagonal bands; only regions whose
count reaches the bound are kept, and banded alignment decides about them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from eventdocs.llm.common import keep_only, pieces, releasing, with_row_key

#: Characters of a q-gram, which is one 64-bit word. Some patterns of under SHORT_UNDER characters may have so many edits that
#: they need not share a q-gram of Q characters; for those it has SHORT_Q.
Q, SHORT_Q, SHORT_UNDER = 8, 5, 32
BUDGET = 0.1
#: Characters of a pattern. An item over SEGMENT characters is held if one of its stretches of this length is, the last of
#: which is at its end.
SEGMENT = 512
#: Bytes of benchmark text that are broadcast at a time, and normalized characters of text worked off at a time.
BLOCK_BYTES, CHUNK = 8 << 20, 1 << 20
_GAPS = re.compile(r"[\W_]+")
_MULTIPLIER, _FILTER_BITS = np.uint64(0x9E3779B97F4A7C15), 22
_APART = 255
#: Regions aligned together; one edit, and a cell that no alignment may enter, in the cells of the alignment.
_ALIGNED, _EDIT, _CLOSED, _NOTHING = 256, np.int32(1 << 12), np.int32(1 << 29), np.uint32(0xFFFFFFFF)


def normalized(text: str) -> str:
    """Lower case, with one space for everything that is no letter or digit."""
    return _GAPS.sub(" ", text.lower()).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _folded(codes: np.ndarray) -> np.ndarray:
    """One byte per character. Equal characters stay equal, so folding only adds candidates."""
    return (codes % 251).astype(np.uint8)


def _grams(folded: np.ndarray, q: int) -> np.ndarray:
    """The q-gram at every place, as overlapping 64-bit words over the same bytes."""
    if len(folded) < q:
        return np.zeros(0, np.uint64)
    padded = folded if q == Q else np.concatenate([folded, np.zeros(Q - q, np.uint8)])
    words = np.ndarray((len(folded) - q + 1,), "<u8", np.ascontiguousarray(padded), strides=(1,))
    return words if q == Q else words & np.uint64((1 << 8 * q) - 1)


def _stretches(codes: np.ndarray, segment: int) -> list[np.ndarray]:
    cuts = {min(a, len(codes) - segment) for a in range(0, len(codes), segment)} if len(codes) > segment else {0}
    return [codes[a : a + segment] for a in sorted(cuts)]


def _vouches(size: int, budget: float, q: int) -> bool:
    """Whether a pattern with all its edits shares a q-gram with its occurrences."""
    return size + 1 - q * (int(budget * size) + 1) >= 1


class Patterns:
    """Patterns (id, codes), each of ``q`` characters at least, and their q-gram index."""

    def __init__(self, patterns: Sequence[tuple[int, np.ndarray]], budget: float = BUDGET, segment: int = SEGMENT, q: int = Q):
        self.q, self.segment = q, segment
        self.ids, self.codes = [i for i, _ in patterns], [c for _, c in patterns]
        sizes = np.array([len(c) for c in self.codes], np.int64)
        # As many edits as the budget allows. Where the lemma can't vouch for them, only those it can.
        self.edits = np.minimum((budget * sizes).astype(np.int64), np.maximum(0, sizes // q - 1))
        self.least = np.maximum(1, sizes + 1 - q * (self.edits + 1))
        grams = [_grams(_folded(c), q) for c in self.codes]
        flat = np.concatenate([np.zeros(0, np.uint64), *grams])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(flat, kind="stable")
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order], place[order]
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self._slot(self.keys)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * _MULTIPLIER) >> np.uint64(64 - _FILTER_BITS)

    def regions(self, folded: np.ndarray) -> list[tuple[int, int]]:
        """(pattern, lowest diagonal of the band) of the bands with enough shared q-grams."""
        grams = _grams(folded, self.q)
        if not len(grams) or not len(self.keys):
            return []
        at = np.flatnonzero(self.seen[self._slot(grams)])
        known = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        exact = self.keys[known] == grams[at]
        at, known = at[exact], known[exact]
        counts = self.count[known]
        total = int(counts.sum())
        within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        entry = np.repeat(self.first[known], counts) + within
        owner = self.owner[entry]
        diagonal = np.repeat(at, counts) - self.place[entry]
        width = self.edits + 1
        band = diagonal // width[owner]
        keys, found = np.unique(owner * (1 << 40) + (band + (1 << 20)), return_counts=True)
        both = found.copy()  # a band is two neighbouring strips, so bands overlap by half
        beside = np.flatnonzero(np.diff(keys) == 1)
        both[beside] += found[beside + 1]
        owner = keys >> 40
        kept = both >= self.least[owner]
        band = (keys[kept] & ((1 << 40) - 1)) - (1 << 20)
        return list(zip(owner[kept].tolist(), (band * width[owner[kept]]).tolist()))

    def align(self, text: np.ndarray, regions: Sequence[tuple[int, int]]) -> list[tuple[int, int, int] | None]:
        """For each region (pattern, diagonal) of the text (edits, start, end) of its best occurrence on the band's
        diagonals and k more on each side, None beyond the budget. Regions are aligned together, row by row."""
        out: list[tuple[int, int, int] | None] = []
        for at in range(0, len(regions), _ALIGNED):
            out += self._align(text, regions[at : at + _ALIGNED])
        return out

    def _align(self, text, regions):
        pattern = np.array([r[0] for r in regions])
        size = np.array([len(self.codes[i]) for i in pattern])
        order = np.argsort(-size, kind="stable")
        pattern, size = pattern[order], size[order]
        k = self.edits[pattern]
        low = np.array([r[1] for r in regions])[order] - k
        own = 4 * k + 2  # diagonals of each band
        wide, deep = int(own.max()), int(size[0])
        want = np.zeros((len(order), deep), np.uint32)
        for row, i in enumerate(pattern):
            want[row, : size[row]] = self.codes[i]
        at = low[:, None] + np.arange(wide + deep)
        inside = (at >= 0) & (at < len(text))
        shown = np.where(inside, text[np.clip(at, 0, len(text) - 1)] if len(text) else 0, _NOTHING)
        # Edits in the high bits and the start in the low ones, so that one minimum keeps both.
        x = np.arange(wide, dtype=np.int32)
        steps = x * _EDIT
        place = low[:, None] + x
        closed = np.where((place >= 0) & (place <= len(text)) & (x < own[:, None]), 0, _CLOSED).astype(np.int32)
        cost = np.maximum(x, closed)
        closed = np.where(x < own[:, None], 0, _CLOSED).astype(np.int32)
        best: list[tuple[int, int, int] | None] = [None] * len(order)
        live = len(order)
        for row in range(deep):
            moved = cost + _EDIT * (shown[:live, row : row + wide] != want[:live, row, None])
            np.minimum(moved[:, :-1], cost[:, 1:] + _EDIT, out=moved[:, :-1])
            cost = np.minimum.accumulate(moved - steps, axis=1) + steps
            np.maximum(cost, closed[:live], out=cost)
            done = int(np.searchsorted(-size[:live], -(row + 1)))
            for i in range(done, live):
                end = int(cost[i].argmin())
                edits, start = divmod(int(cost[i, end]), int(_EDIT))
                if edits <= k[i]:
                    found = (edits, int(low[i]) + start, min(len(text), int(low[i]) + end + row + 1))
                    best[int(order[i])] = found
            if done < live:
                live = done
                cost = cost[:live]
            if not live:
                break
        return best

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For each item found: (edits, start, end) of its best and then first occurrence in a normalized text."""
        whole, overlap = text, 4 * self.segment
        found: dict[int, tuple[int, int, int]] = {}
        for at in range(0, max(1, len(whole) - overlap), CHUNK):
            part = _codes(whole[at : at + CHUNK + overlap])
            self.collect(part, at, self.regions(_folded(part)), found)
        return found

    def collect(self, part: np.ndarray, at: int, regions, found: dict) -> None:
        for (pattern, _), hit in zip(regions, self.align(part, regions)):
            if hit:
                hit = (hit[0], hit[1] + at, hit[2] + at)
                item = self.ids[pattern]
                if item not in found or hit < found[item]:
                    found[item] = hit

    def _hits(self, parts: list[np.ndarray], starts: np.ndarray, regions) -> Iterator[tuple[int, int, tuple]]:
        """(pattern, text, hit) of the regions of several texts laid end to end. All are aligned together; between texts
        stand characters that no pattern holds, and a hit that reaches over them is looked for in each text by itself."""
        gap = np.full(Q, _NOTHING - np.uint32(1), np.uint32)
        flat = np.concatenate([y for p in parts for y in (p, gap)])
        for (pattern, diagonal), hit in zip(regions, self.align(flat, regions)):
            if not hit:
                continue
            t = int(np.searchsorted(starts, hit[1], "right")) - 1
            if hit[2] <= starts[t] + len(parts[t]):
                yield pattern, t, (hit[0], hit[1] - int(starts[t]), hit[2] - int(starts[t]))
                continue
            for t in range(t, min(int(np.searchsorted(starts, hit[2], "right")), len(parts))):
                alone = self.align(parts[t], [(pattern, diagonal - int(starts[t]))])[0]
                if alone:
                    yield pattern, t, alone

    def search(self, texts: Sequence[str]) -> list[dict[int, tuple[int, int, int]]]:
        """``matches`` of every normalized text; short ones are scanned together."""
        shown = texts
        found: list[dict] = [{} for _ in texts]
        group: list[int] = []

        def scan() -> None:
            parts = [_codes(shown[i]) for i in group]
            gap = np.full(Q, _APART, np.uint8)
            flat = np.concatenate([y for p in parts for y in (_folded(p), gap)])
            starts = np.concatenate([[0], np.cumsum([len(p) + Q for p in parts])])
            for pattern, t, hit in self._hits(parts, starts, self.regions(flat)):
                item = self.ids[pattern]
                if item not in found[group[t]] or hit < found[group[t]][item]:
                    found[group[t]][item] = hit
            group.clear()

        size = 0
        for i, text in enumerate(shown):
            if len(text) > CHUNK:
                found[i] = self.matches(text)
                continue
            group.append(i)
            size += len(text)
            if size >= CHUNK:
                scan()
                size = 0
        if group:
            scan()
        return found


class Items:
    """The patterns of a block of items (id, text), each with the search that finds it with all its edits: by q-grams, by shorter
    ones, or, under Q characters, where no edit is allowed, as whole words."""

    def __init__(self, items: Sequence[tuple[int, str]], budget: float = BUDGET, segment: int = SEGMENT):
        by_q: dict[int, list[tuple[int, np.ndarray]]] = {Q: [], SHORT_Q: []}
        self.words = ahocorasick.Automaton()
        for item, text in items:
            shown = normalized(text or "")
            if 0 < len(shown) < Q:
                spaced = f" {shown} "
                self.words.add_word(spaced, (len(shown), self.words.get(spaced, (0, ()))[1] + (item,)))
            elif shown:
                for codes in _stretches(_codes(shown), segment):
                    short = len(codes) < SHORT_UNDER and not _vouches(len(codes), budget, Q)
                    by_q[SHORT_Q if short else Q].append((item, codes))
        self.words.make_automaton()
        self.patterns = [Patterns(own, budget, segment, q) for q, own in by_q.items() if own]

    def search(self, texts: Sequence[str]) -> list[dict[int, tuple[int, int, int]]]:
        """For each text and each item that it holds: (edits, start, end) of its best and then first occurrence in the
        normalized text."""
        shown = [normalized(t) for t in texts]
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        for patterns in self.patterns:
            for own, hits in zip(found, patterns.search(shown)):
                for item, hit in hits.items():
                    own[item] = min(hit, own.get(item, hit))
        if len(self.words):
            for own, text in zip(found, shown):
                for end, (size, items) in self.words.iter(f" {text} "):
                    for item in items:
                        own[item] = min((0, end - 1 - size, end - 1), own.get(item, (0, end, end)))
        return found


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    budget: float = BUDGET,
    block_bytes: int = BLOCK_BYTES,
    segment: int = SEGMENT,
) -> DataFrame:
    """(key, row_key, item, edits, start, end) for every row and item whose text the whole text holds.

    Texts are compared in lower case with one space for everything that is no letter or digit; an item is held if some
    part of the text differs from it by at most ``budget`` times its length in edits. ``start`` and ``end`` are the best
    and then first occurrence in that normalized text. An item longer than ``segment`` is held if a stretch of that length
    is; with a ``segment`` as long as the longest item, only whole items are. Items under 8 characters have no edits and
    are looked for as whole words. Empty and null items match nothing, null and empty texts hold nothing. Repeated rows and items and null keys each give their own rows;
    empty tables give an empty one; other columns are not read.

    Documents are not shuffled. The benchmark is broadcast in blocks of about ``block_bytes``, each searched in all
    documents.
    """
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("row_key", T.LongType()),
            T.StructField(item, benchmark.schema[item].dataType),
            *(T.StructField(n, T.LongType()) for n in ("edits", "start", "end")),
        ]
    )
    kind = to_arrow_type(schema[item].dataType)

    def searched(block: Broadcast) -> DataFrame:
        @releasing
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_only("decontamination")
            ids, texts = zip(*block.value) if block.value else ((), ())
            patterns = Items(list(enumerate(texts)), budget, segment)
            for batch in pieces(batches, "text", 4 << 20):
                at, found = [], []
                for row, hits in enumerate(patterns.search(batch.column("text").to_pylist())):
                    for number, hit in sorted(hits.items()):
                        at.append(row)
                        found.append((number, *hit))
                kept = batch.select([key, "row_key"]).take(pa.array(at, pa.int64()))
                columns = list(zip(*found)) or [()] * 4
                named = pa.array([ids[n] for n in columns[0]], kind)
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, named, *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names
                )

        return with_row_key(docs, key).mapInArrow(search, schema)

    return reduce(DataFrame.unionByName, [searched(b) for b in _blocks(benchmark, item, block_bytes)])


def _blocks(benchmark: DataFrame, item: str, block_bytes: int) -> list[Broadcast]:
    """The items (id, text) in blocks of about ``block_bytes``, one at least."""
    items = benchmark.select(F.col(item), F.coalesce("text", F.lit("")).alias("_item_text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("_item_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64(item, "_item_text"), F.lit(blocks))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast([tuple(r) for r in items.where(part == b).collect()]) for b in range(blocks)]


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    item: str = "item_id",
    budget: float = BUDGET,
    block_bytes: int = BLOCK_BYTES,
    segment: int = SEGMENT,
) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose whole text holds no item (see ``find_leaks``). No shuffle."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    for block in _blocks(benchmark, item, block_bytes):

        @releasing
        def clean(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            keep_only("decontamination")
            patterns = Items(block.value, budget, segment)
            for batch in pieces(batches, "text", 4 << 20):
                hits = patterns.search(batch.column("text").to_pylist())
                yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

        rows = rows.mapInArrow(clean, rows.schema)
    return rows.select("row.*")
