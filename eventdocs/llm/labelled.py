"""Bounded samples of labelled documents, and hashed words, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventdocs.llm.common import drop_written, keep_only, pieces, text_of, written

BUCKETS = 1 << 16
#: Bounds of a training sample: rows of one label, words and bytes of one row, and labels. They bound what the driver holds.
SAMPLE_ROWS, SAMPLE_WORDS, SAMPLE_BYTES, MOST_LABELS = 6_000, 3_000, 1 << 15, 16
_CACHED_WORDS, _CACHED_BYTES = 400_000, 100
_ENDS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”„‚‘’¿¡…–—"


def held_out(key: str) -> Column:
    """Whether labels of a row may not be learned from: crc32 of the key as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class HashedWords(dict):
    """Bucket of a word in lower case without ASCII punctuation at its ends; bucket 0 stays free."""

    def __init__(self, buckets: int = BUCKETS):
        super().__init__()
        self.buckets = buckets

    def value(self, word: bytes) -> int:
        text = word.decode().lower().strip(_ENDS)
        return 1 + xxhash.xxh32_intdigest(text.encode()) % (self.buckets - 1) if text else 0

    def __missing__(self, word: bytes) -> int:
        found = self.value(word)
        if len(word) <= _CACHED_BYTES:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label: Column,
    key: str = "doc_id",
    rows: int = SAMPLE_ROWS,
    words: int = SAMPLE_WORDS,
    extra: tuple[str, ...] = (),
) -> list:
    """At most ``rows`` rows (label, text, *extra) of each label, taken in the order of the key's hash.

    Only labelled rows outside the held-out fold with at most ``words`` words and SAMPLE_BYTES bytes are eligible, so what the
    driver holds is bounded. More than MOST_LABELS labels raise an error. Null labels and null keys are left out; a key that is labelled twice counts once per label.
    """
    marked = labels.where(~held_out(key) & F.col(key).isNotNull())
    marked = marked.select(key, label.alias("_label")).where("_label IS NOT NULL").distinct()
    texts = docs.select(key, text_of().alias("_text"), *extra)
    # Narrow rows first: which keys are taken is decided without their texts.
    short = texts.where(F.octet_length("_text") <= SAMPLE_BYTES)
    short = short.where(F.size(F.split("_text", "[ \t\n\x0b\f\r]+")) <= words).select(key)
    eligible = written(short.join(marked, key).distinct(), "labelled")
    kinds = sorted(r[0] for r in eligible.select("_label").distinct().limit(MOST_LABELS + 1).collect())
    if len(kinds) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    taken = [
        eligible.where(F.col("_label") == kind).orderBy(F.xxhash64(key), key).limit(rows) for kind in kinds
    ]
    if not taken:
        return []
    # At most ``rows`` keys of each of 16 labels, so they may be sent to the texts, whatever the size of the corpus.
    chosen = texts.join(F.broadcast(reduce(DataFrame.unionByName, taken)), key).dropDuplicates([key, "_label"])
    found = [tuple(r) for r in chosen.select("_label", "_text", *extra, key).collect()]
    drop_written(eligible)
    return [r[:-1] for r in sorted(found, key=lambda r: (r[0], r[-1]))]


def scored(docs: DataFrame, key: str, score, names: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, *extra, *names) of every row; ``score`` maps a list of whole texts as bytes to one array per name."""
    schema = T.StructType(
        [docs.schema[key], *(docs.schema[e] for e in extra), *(T.StructField(n, T.DoubleType()) for n in names)]
    )

    shown = "text" if "text" in extra else "_text"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("words")
        for batch in pieces(rows, shown, 1 << 20):
            texts = [t or b"" for t in batch.column(shown).cast(pa.large_binary()).to_pylist()]
            found = [pa.array(np.asarray(a, float)) for a in score(texts)]
            kept = [batch.column(n) for n in (key, *extra)]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=schema.names)

    others = [] if shown in extra else [text_of().alias("_text")]
    return docs.select(key, *extra, *others).mapInArrow(run, schema)
