"""Repeated windows of all documents: the steps that the FM-index and the suffix-array dedup share.

1. Count the keys of all windows' runs (see ``windows``), and keep the runs whose key occurs more than once.
2. Group runs with equal content; one of them stands for all. Keys with one content only need no comparison.
3. Fetch the contents of the others and deal them out to shards by key, so equal windows meet in one shard.
4. An index over each shard reports, for each content, which stretches of it repeat.
5. Join the verdicts back to all runs and cut the stretches out of the whole texts.

All tables between the steps are narrow and written to the shared folder; texts are shuffled compressed, in steps 3 and 5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventdocs.llm import windows
from eventdocs.llm.common import drop_written, keep_only, pieces, with_row_key, written

#: Symbols that are hashed together, and at most (longer documents are hashed in overlapping parts).
_TOGETHER, _PART = 1 << 16, 1 << 20
#: A run's place in its row: 31 bits of the first window, 1 for ``again``, 7 of the number of windows. A row is named by its
#: key and its ``tag``, the whole 64-bit row key.
_FIRST_BITS = 31


@dataclass(frozen=True)
class Kind:
    """What repeats: how a text becomes 64-bit symbols, how long a window is, and whether its first place stays."""

    symbols: Callable[[bytes], np.ndarray]
    #: Bytes of the symbols from a to b, for the shards.
    content: Callable[[bytes], Callable[[int, int], bytes]]
    length: int
    gram: int
    keep_first: bool
    symbol_bytes: int
    #: Shard rows (contents, copies) to one array of (start, end) pairs per content.
    search: Callable[[list[bytes], np.ndarray, int], list[np.ndarray]]
    shard_symbols: int


def _place(first: np.ndarray, again: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << 8) | (again.astype(np.int64) << 7) | count.astype(np.int64)


def _first(place: str):
    return F.shiftrightunsigned(place, 8).bitwiseAND(F.lit((1 << _FIRST_BITS) - 1))


def _count(place: str):
    return F.col(place).bitwiseAND(F.lit(127))


def _runs(docs: DataFrame, key: str, kind: Kind, place: bool) -> DataFrame:
    """(m, rh, id, tag, place) of all runs, or (m, times) for the count of keys."""
    fields = [("m", T.LongType())]
    fields += (
        [("rh", T.LongType()), ("id", docs.schema[key].dataType), ("tag", T.LongType()), ("place", T.LongType())]
        if place
        else [("times", T.IntegerType())]
    )
    schema = T.StructType([T.StructField(*f) for f in fields])

    def found(rows: list[int], parts: list[np.ndarray], offsets: list[int]) -> tuple[np.ndarray, ...]:
        owner, first, count, m, rh, again = windows.runs(
            np.concatenate(parts), np.cumsum([len(p) for p in parts]), kind.length, kind.gram
        )
        return np.array(rows)[owner], first + np.array(offsets)[owner], count, m, rh, again

    def all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("repeats")
        for batch in pieces(batches, "text", 2 << 20):
            rows, parts, offsets, size, results = [], [], [], 0, []
            for row, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                symbols = kind.symbols(text)
                for at in range(0, max(1, len(symbols) - kind.length + 1), _PART):
                    part = symbols[at : at + _PART + kind.length - 1]
                    if len(part) < kind.length:
                        continue
                    rows.append(row)
                    parts.append(part)
                    offsets.append(at)
                    size += len(part)
                    if size >= _TOGETHER:
                        results.append(found(rows, parts, offsets))
                        rows, parts, offsets, size = [], [], [], 0
            if rows:
                results.append(found(rows, parts, offsets))
            if not results:
                continue
            row, first, count, m, rh, again = (np.concatenate(x) for x in zip(*results))
            if not place:
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(1 + again.astype(np.int32))], names=schema.names)
                continue
            own = batch.column("row_key").to_numpy()[row]
            arrays = [pa.array(m), pa.array(rh), batch.column(key).take(pa.array(row))]
            arrays += [pa.array(own), pa.array(_place(first, again, count))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return with_row_key(docs, key).mapInArrow(all_runs, schema)


def _zipped(docs: DataFrame, key: str) -> DataFrame:
    """(id, tag, zipped): the whole texts, compressed."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[key].dataType),
            T.StructField("tag", T.LongType()),
            T.StructField("zipped", T.BinaryType()),
        ]
    )

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, "text"):
            zipped = [packer.compress(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            arrays = [batch.column(key), batch.column("row_key"), pa.array(zipped, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return with_row_key(docs, key).mapInArrow(compress, schema)


def _unzip(batch: pa.RecordBatch) -> Iterator[bytes]:
    reader = zstandard.ZstdDecompressor()
    for value in batch.column("zipped").to_pylist():
        yield reader.decompress(value) if value else b""


def _same(a: DataFrame, b: DataFrame):
    return (a["tag"] == b["tag"]) & a["id"].eqNullSafe(b["id"])


def _contents(docs: DataFrame, key: str, wanted: DataFrame, kind: Kind, shards: int) -> DataFrame:
    """(shard, m, rh, id, tag, place, copies, content) of the wanted (m, rh, id, tag, place, copies)."""
    runs = F.collect_list(F.struct("m", "rh", "place", "copies")).alias("runs")
    lists = wanted.groupBy("id", "tag").agg(runs)
    texts = _zipped(docs, key)
    joined = texts.join(lists, _same(texts, lists)).select(texts["id"], texts["tag"], "zipped", "runs")
    schema = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("m", T.LongType()), T.StructField("rh", T.LongType())]
        + [T.StructField("id", docs.schema[key].dataType), T.StructField("tag", T.LongType())]
        + [T.StructField("place", T.LongType())]
        + [T.StructField("copies", T.LongType()), T.StructField("content", T.BinaryType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                lists = batch.column("runs")
                flat = lists.flatten()
                m, rh, place, copies = (flat.field(i).to_numpy() for i in range(4))
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                first, count = (place >> 8) & ((1 << _FIRST_BITS) - 1), place & 127
                found, i = [], 0
                for number, text in enumerate(_unzip(batch)):
                    content = kind.content(text)
                    while i < len(row) and row[i] == number:
                        found.append(content(int(first[i]), int(first[i] + count[i]) + kind.length - 1))
                        i += 1
                shard = ((m.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)
                arrays = [pa.array(shard.astype(np.int32)), pa.array(m), pa.array(rh)]
                arrays += [batch.column(c).take(pa.array(row)) for c in ("id", "tag")] + [pa.array(place), pa.array(copies)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, pa.binary())], names=schema.names)

    return joined.mapInArrow(cut, schema)


def _verdicts(contents: DataFrame, kind: Kind) -> DataFrame:
    """(m, rh, spans): the repeated stretches of the contents that have any, as pairs of 32-bit places."""
    schema = T.StructType(
        [T.StructField("m", T.LongType()), T.StructField("rh", T.LongType()), T.StructField("spans", T.BinaryType())]
    )

    def search(table: pa.Table) -> pa.Table:
        # Contents in the order of the corpus, null keys last; places are compared from the first window on.
        known = pa.compute.is_null(table["id"])
        first = pa.compute.bit_wise_and(pa.compute.shift_right(table["place"], 8), (1 << _FIRST_BITS) - 1)
        order = pa.table({"k": known, "id": table["id"], "t": table["tag"], "f": first})
        rows = pa.compute.sort_indices(order, [(n, "ascending") for n in ("k", "id", "t", "f")])
        table = table.take(rows).combine_chunks()
        # Repeated rows of a document have sent their contents more than once.
        pair = np.stack([table[c].to_numpy() for c in ("m", "rh", "tag", "place")], 1)
        table = table.filter(pa.array(np.append(True, (pair[1:] != pair[:-1]).any(1))))
        spans = kind.search(table["content"].to_pylist(), table["copies"].to_numpy(), kind.length)
        hit = [i for i, s in enumerate(spans) if len(s)]
        kept = table.take(pa.array(hit, pa.int64()))
        data = pa.array([np.asarray(spans[i], "<i4").tobytes() for i in hit], pa.binary())
        return pa.table([kept["m"].combine_chunks(), kept["rh"].combine_chunks(), data], names=schema.names)

    return contents.groupBy("shard").applyInArrow(search, schema)


def removals(docs: DataFrame, key: str, kind: Kind) -> DataFrame:
    """(id, tag, cuts): for each document that loses anything its stretches (start, end), in symbols, unordered."""
    repeated = _runs(docs, key, kind, False).groupBy("m").agg(F.sum("times").alias("n")).where("n >= 2").select("m")
    repeated = written(repeated, "keys")
    runs = written(_runs(docs, key, kind, True).join(repeated, "m"), "runs")
    drop_written(repeated)

    place = F.struct(F.col("id").isNull().alias("last"), "id", "tag", "place")
    groups = runs.groupBy("m", "rh").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("one"))
    groups = groups.select("m", "rh", "copies", *[F.col(f"one.{c}").alias(c) for c in ("id", "tag", "place")])
    groups = written(groups, "contents")
    again = F.max(F.shiftright("place", 7).bitwiseAND(F.lit(1))) == 1
    compared = groups.groupBy("m").agg(((F.count(F.lit(1)) > 1) | again).alias("compared")).where("compared").select("m")
    # As a table of its own, so that AQE may split the contents of one key in the join.
    compared = written(compared, "compared-keys")
    wanted = written(groups.join(compared, "m"), "compared")
    drop_written(compared)
    total = wanted.agg(F.coalesce(F.sum(_count("place") + kind.length), F.lit(0))).first()[0]
    shards = max(1, -(-total // kind.shard_symbols))
    verdicts = written(_verdicts(_contents(docs, key, wanted, kind, shards), kind), "verdicts")

    ends = groups.join(verdicts, ["m", "rh"], "left").where("spans IS NOT NULL OR copies > 1")
    ends = ends.select(
        "m", "rh", "copies", F.col("id").alias("one"), F.col("tag").alias("one_tag"), F.col("place").alias("one_place"), "spans"
    )
    ends = written(ends, "decisions")
    whole = F.col("copies") > 1
    if kind.keep_first:
        first = (F.col("tag") == F.col("one_tag")) & (F.col("place") == F.col("one_place"))
        whole = whole & ~(F.col("id").eqNullSafe(F.col("one")) & first)
    found = runs.join(ends, ["m", "rh"]).select(
        "id",
        "tag",
        F.struct(
            _first("place").cast("int").alias("first"),
            F.when(whole, _count("place") + (kind.length - 1)).otherwise(0).cast("int").alias("whole"),
            F.when(~whole, F.col("spans")).alias("spans"),
        ).alias("cut"),
    )
    found = found.where("cut.whole > 0 OR cut.spans IS NOT NULL")
    cuts = written(found.groupBy("id", "tag").agg(F.collect_list("cut").alias("cuts")), "cuts")
    for table in (runs, groups, wanted, verdicts, ends):
        drop_written(table)
    return cuts


def _spans(firsts: np.ndarray, wholes: np.ndarray, spans: Sequence[bytes | None]) -> np.ndarray:
    """Merged (start, end) rows in order."""
    own = np.stack([firsts, firsts + wholes], 1)[wholes > 0]
    pairs = [np.frombuffer(s, "<i4").reshape(-1, 2).astype(np.int64) + f for f, s in zip(firsts, spans) if s]
    rows = np.concatenate([own, *pairs]).astype(np.int64)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    reach = np.maximum.accumulate(rows[:, 1])
    starts = np.concatenate([[True], rows[1:, 0] > reach[:-1]])
    at = np.flatnonzero(starts)
    return np.stack([rows[at, 0], np.append(reach[at[1:] - 1], reach[-1])], 1)


def cut_out(
    docs: DataFrame,
    key: str,
    kind: Kind,
    rebuild: Callable[[bytes, np.ndarray], tuple[bytes, int, int]],
) -> DataFrame:
    """(key, kept, total, removed, spans) of every row; ``rebuild`` gives kept bytes, symbols and removed symbols."""
    cuts = removals(docs, key, kind)
    texts = _zipped(docs, key)
    joined = texts.join(cuts, _same(texts, cuts), "left").select(texts["id"], "zipped", "cuts")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("kept", T.BinaryType()),
            T.StructField("total", T.LongType()),
            T.StructField("removed", T.LongType()),
            T.StructField("spans", T.ArrayType(span)),
        ]
    )
    none = np.zeros((0, 2), np.int64)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column("cuts")
                kept, totals, removed, spans = [], [], [], []
                for text, cut in zip(_unzip(batch), lists):
                    merged = none
                    if cut.is_valid and len(cut.values):
                        first, size = (cut.values.field(i).to_numpy().astype(np.int64) for i in range(2))
                        merged = _spans(first, size, cut.values.field(2).to_pylist())
                    left, total, gone = rebuild(text, merged)
                    kept.append(left)
                    totals.append(total)
                    removed.append(gone)
                    spans.append([{"start": int(a), "end": int(b)} for a, b in merged])
                arrays = [batch.column("id"), pa.array(kept, pa.binary()), pa.array(totals, pa.int64())]
                arrays += [pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return joined.mapInArrow(build, schema)
