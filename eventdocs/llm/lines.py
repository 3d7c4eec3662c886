"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n): a line key's 128-bit hash and the number of documents that hold it, hashed to
buckets by h1 and sorted in each. A batch of documents is merge-anti-joined with the runs, which leaves out
keys that a run already knows to be frequent, and its counts become a new run of level 0. As soon as a level has
``fanout`` runs they are merged into one run of the next level, so N batches leave about log N runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventdocs.llm.common import (
    BLANKS,
    drop_path,
    drop_written,
    keep_only,
    new_path,
    parts,
    pieces,
    releasing,
    same_row,
    with_row_key,
    written,
)

MIN_DOCS = 10
BATCHES = 8
FANOUT = 4
_STRIPPED = BLANKS.encode()


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lowered."""
    return line.strip(_STRIPPED).lower()


class LineRuns:
    """The levelled runs. They live as bucketed tables in the session's shared folder until ``clear``."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or parts(spark)
        self.levels: list[list[str]] = [[]]
        self._name = f"line_runs_{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"{self._name}_{level}_{len(self._paths)}"
        self._paths[name] = new_path(self.spark, "line-run")
        writer = rows.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2")
        writer.option("path", self._paths[name]).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, batch: DataFrame) -> None:
        """Adds the counts (h1, h2, n) of a batch, one row per key."""
        for name in self.names():
            settled = self.spark.table(name).where(F.col("n") >= self.min_docs)
            batch = batch.join(settled, ["h1", "h2"], "left_anti")
        self._write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(self._sum(merged), level + 1)
            self._drop(merged)
            level += 1

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _sum(self, names: list[str]) -> DataFrame:
        # Dealt out anew: a union of bucketed tables claims their bucketing, but Spark 4.1 does not line the buckets up.
        runs = reduce(DataFrame.unionByName, [self.spark.table(n) for n in names]).repartition("h1", "h2")
        return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys that at least ``min_docs`` documents hold."""
        return self._sum(self.names()).where(F.col("n") >= self.min_docs).select("h1", "h2")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, self._paths[name])

    def clear(self) -> None:
        self._drop(self.names())
        self.levels = [[]]


def line_hashes(docs: DataFrame, key: str, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """(key, row_key, pos, h1, h2, first, batch): a row per line whose key has ``min_chars`` code points or more.

    ``first`` marks the first line with its key in the document, so that a document counts once.
    """
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("row_key", T.LongType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("h1", T.LongType()),
            T.StructField("h2", T.LongType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("batch", T.IntegerType()),
        ]
    )

    @releasing
    def explode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("lines")
        for batch in pieces(rows, "text"):
            at, pos, digests, first = [], [], [], []
            for row, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                seen = set()
                for i, line in enumerate(text.split(b"\n")):
                    shown = line_key(line)
                    if not shown or (min_chars > 1 and len(shown.decode()) < min_chars):
                        continue
                    digest = xxhash.xxh3_128_digest(shown)
                    at.append(row)
                    pos.append(i)
                    digests.append(digest)
                    first.append(digest not in seen)
                    seen.add(digest)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            own = batch.select([key, "row_key"]).take(pa.array(at, pa.int64()))
            part = own.column("row_key").to_numpy(zero_copy_only=False) % batches
            columns = [pa.array(pos, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            columns += [pa.array(first, pa.bool_()), pa.array(part, pa.int32())]
            yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=schema.names)

    return with_row_key(docs, key).mapInArrow(explode, schema)


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    min_docs: int = MIN_DOCS,
    min_chars: int = 1,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(key, row_key, *carry, kept, n_lines, n_dropped) of every row, in whole texts.

    A line's key is the line stripped of ASCII white space and with A-Z lowered. Keys of at least ``min_chars`` code
    points that at least ``min_docs`` rows hold lose all their lines; blank lines always stay. Null and empty texts are
    one empty line. Each repeated row is a document of its own; null keys are kept. An empty table gives an empty one;
    other columns are not read.

    Hashes have 128 bits. A frequent line's counts are summed before each shuffle, and the join that finds its places
    may be split by AQE, as its other side has one row per key.
    """
    spark = docs.sparkSession
    hashes = line_hashes(docs, key, min_chars, batches)
    hashes = written(hashes, "line-hashes")
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        own = hashes.where((F.col("batch") == batch) & F.col("first"))
        runs.add(own.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")))
    # As a table of its own, so that AQE may split a frequent line's places in the join.
    frequent = written(runs.frequent(), "frequent-lines")
    hit = hashes.join(frequent, ["h1", "h2"]).groupBy(key, "row_key").agg(F.collect_set("pos").alias("dropped"))
    hit = written(hit, "line-drops")
    runs.clear()
    drop_written(hashes)
    whole = with_row_key(docs, key, carry=carry)
    joined = whole.join(hit, same_row(whole, hit, key), "left").select(
        whole[key], whole["row_key"], whole["text"], *carry, hit["dropped"]
    )
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("row_key", T.LongType()),
            *(docs.schema[c] for c in carry),
            T.StructField("kept", T.StringType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
        ]
    )

    @releasing
    def rebuild(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(rows, "text"):
            kept, total, gone = [], [], []
            texts = batch.column("text").to_pylist()
            for text, dropped in zip(texts, batch.column("dropped").to_pylist()):
                lines = text.split("\n")
                total.append(len(lines))
                if dropped:
                    out = set(dropped)
                    lines = [line for i, line in enumerate(lines) if i not in out]
                gone.append(total[-1] - len(lines))
                kept.append("\n".join(lines))
            columns = [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            own = [batch.column(n) for n in (key, "row_key", *carry)]
            yield pa.RecordBatch.from_arrays([*own, *columns], names=schema.names)

    return joined.mapInArrow(rebuild, schema)
