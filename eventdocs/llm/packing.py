"""Packing: shortest-pack-first over the histogram of piece lengths.

Documents are tokenized once and cut into whole sequences and a rest. Only the histogram of piece lengths, one number
per length up to the sequence length, comes to the driver. Lengths are placed longest first, each into the emptiest
pack that has room; packs with the same content are one pattern with a count. Patterns are then joined back to the
pieces by their rank among pieces of the same length.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventdocs.llm.common import keep_only, keeps, pieces, releasing, with_row_key, written

MAX_TOKENS, END_ID = 2048, 1
TOKENIZER = "word_bpe_49k.json"
_MARKS = ".,;:!?)]}\"%&$#*|-"
#: Words, and runs of letters, whose ids a worker keeps, and the longest such word in bytes.
CACHED, CACHED_BYTES = 600_000, 100
_encoders: dict[str, WordIds] = {}
keeps("packing", _encoders.clear)


class WordIds:
    """Ids of texts as little-endian 32-bit integers, word by word.

    The tokenizer drops white space and no merge crosses it, so a text's ids are those of its words in order. It also
    ignores case and cuts runs of letters from what is around them, so a word of letters with marks at its end has the
    ids of its lower-case letters and then of the marks. Ids of words and of runs are kept; new runs are encoded together.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_runs(self, runs: list[str]) -> None:
        found = self.tokenizer.encode(" ".join(runs), add_special_tokens=False)
        ids, owner = np.array(found.ids, "<u4"), np.array(found.word_ids, float)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        parts = np.split(ids, cuts)
        if len(parts) == len(runs) and not np.isnan(owner).any():
            self.runs.update(zip(runs, (p.tobytes() for p in parts)))
        else:
            self.runs.update((r, self.encode(r)) for r in runs)

    @staticmethod
    def _split(word: bytes) -> tuple[str, str]:
        """The lower-case letters and the marks after them; no letters where the word is not of that kind."""
        text = word.decode()
        body = text.rstrip(_MARKS)
        plain = body.isalpha() and "\u03a3" not in body and "\u0130" not in body
        return (body.lower(), text[len(body) :]) if plain else ("", text)

    def learn(self, texts: list[list[bytes]]) -> None:
        new = set().union(*texts).difference(self.words) if texts else set()
        if len(self.words) > CACHED:
            self.words.clear()
            new = set().union(*texts)
        if len(self.runs) > CACHED:
            self.runs.clear()
        parts = {w: self._split(w) for w in new if len(w) <= CACHED_BYTES}
        runs = {r for pair in parts.values() for r in pair if r}.difference(self.runs)
        letters = [r for r in runs if r.isalpha()]
        if letters:
            self._learn_runs(letters)
        for run in runs:
            if run not in self.runs:
                self.runs[run] = self.encode(run)
        self.words.update((w, self.runs.get(a, b"") + self.runs.get(b, b"")) for w, (a, b) in parts.items())

    def ids(self, words: list[bytes]) -> bytes:
        """After ``learn``. Very long words are encoded each time."""
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            return b"".join(self.words[w] if w in self.words else self.encode(w.decode()) for w in words)


def word_ids(name: str) -> WordIds:
    """The worker's own encoder; a file of this name may be given by its path too."""
    if name not in _encoders:
        _encoders[name] = WordIds(name)
    return _encoders[name]


def shortest_pack_first(histogram: Mapping[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their counts. Counts of all lengths used equal the histogram.

    A pattern is split only when a length runs out, so there are at most two patterns per length.
    """
    by_used: dict[int, list[list]] = {}
    heap: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], used: int, count: int) -> None:
        if used == most:
            done.append((pattern, count))
            return
        if used not in by_used:
            by_used[used] = []
            heapq.heappush(heap, used)
        by_used[used].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if heap and heap[0] + length <= most:
                used = heap[0]
                entry = by_used[used][-1]
                take = min(left, entry[1])
                if take == entry[1]:
                    by_used[used].pop()
                    if not by_used[used]:
                        del by_used[used]
                        heapq.heappop(heap)
                else:
                    entry[1] -= take
                put((*entry[0], length), used + length, take)
            else:
                take = left
                put((length,), length, take)
            left -= take
    return done + [(p, c) for entries in by_used.values() for p, c in entries]


def _placements(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) sorted by length and rank: one per slot of a pattern."""
    rows, used, sequence = [], Counter(), 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def cut_pieces(docs: DataFrame, key: str, tokenizer: str = TOKENIZER, most: int = MAX_TOKENS) -> DataFrame:
    """(key, row_key, part, start, length, ids_crc32, doc_tokens, rank): rank counts a part's pieces of one length."""
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("row_key", T.LongType()),
            T.StructField("part", T.IntegerType()),
            *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "rank")),
        ]
    )
    end = np.array([END_ID], "<u4").tobytes()

    @releasing
    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("packing")
        encoder, ranks, part = word_ids(tokenizer), Counter(), TaskContext.get().partitionId()
        for batch in pieces(rows, "text", 4 << 20):
            at, found = [], []
            texts = [t.split() for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            encoder.learn(texts)
            for row, words in enumerate(texts):
                ids = encoder.ids(words) + end
                total = len(ids) // 4
                for start in range(0, total, most):
                    piece = ids[4 * start : 4 * (start + most)]
                    length = len(piece) // 4
                    at.append(row)
                    found.append((start, length, zlib.crc32(piece), total, ranks[length]))
                    ranks[length] += 1
            own = batch.select([key, "row_key"]).take(pa.array(at, pa.int64()))
            columns = np.array(found, np.int64).reshape(-1, 5).T
            arrays = [*own.columns, pa.array(np.full(len(at), part, np.int32)), *map(pa.array, columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return with_row_key(docs, key).mapInArrow(cut, schema)


def pack(docs: DataFrame, key: str = "doc_id", tokenizer: str = TOKENIZER, most: int = MAX_TOKENS) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every row.

    A null or empty text is the end id alone. Repeated rows and null keys are packed like any other, each row's pieces
    with its own key. An empty table gives an empty one; other columns are not read. Pieces of a text of any length fill
    whole sequences, only the rest is packed with others.

    The pieces, without their ids, are a table in the shared folder, so their ranks do not change when a task is run
    again. The driver sees one count per length. The slots it sends back are bounded by the sequence length, not by the
    corpus: two patterns per length, each with ``most`` slots at most.
    """
    spark = docs.sparkSession
    cut = written(cut_pieces(docs, key, tokenizer, most), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "ranks")
    histogram = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_placements(shortest_pack_first(histogram, most)))
    ranked = cut.join(firsts.drop("n"), ["length", "part"])
    ranked = ranked.select(
        key, "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("first")).alias("rank")
    )
    schema = T.StructType(
        [
            docs.schema[key],
            *(
                T.StructField(n, T.LongType())
                for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            ),
        ]
    )

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        first_of = np.searchsorted(table[:, 0], np.arange(most + 2))
        for batch in rows:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            at = np.empty(len(rank), np.int64)
            for value in np.unique(length):
                own = length == value
                low, high = first_of[value], first_of[value + 1]
                at[own] = low + np.searchsorted(table[low:high, 1], rank[own], "right") - 1
            sequence = pa.array(table[at, 2] + rank - table[at, 1])
            kept = [batch.column(n) for n in (key, "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, sequence, pa.array(table[at, 3])], names=schema.names)

    return ranked.mapInArrow(place, schema)
