"""Files that cannot be read, or not to their end: they are skipped, and reported."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reader options: a damaged file ends where the damage begins, one that has gone meanwhile is empty, and the job goes on.
LENIENT = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
_STEP = 1 << 20


def listed_files(spark: SparkSession, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """(file, *keep) of all files of a folder that hold anything, without reading them; ``keep`` names partition columns."""
    files = spark.read.format("binaryFile").options(**LENIENT).load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), *keep)


def _torn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of the compressed files do not unpack to their end."""

    def whole(content: bytes) -> bool:
        while content:
            unpack = zlib.decompressobj(31)
            try:
                for at in range(0, len(content), _STEP):
                    part = content[at : at + _STEP]
                    while part:
                        unpack.decompress(part, _STEP)
                        part = unpack.unconsumed_tail
                    if unpack.eof:
                        break
            except zlib.error:
                return False
            if not unpack.eof:
                return False
            content = (unpack.unused_data + content[at + _STEP :]).lstrip(b"\0")
        return True

    for batch in batches:
        torn = [not whole(c or b"") for c in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(torn)], names=["file", "torn"])


def torn_files(spark: SparkSession, path: str) -> DataFrame:
    """(file): gzip files that break off or hold other bytes. Each is unpacked by one task, as it is when it is read."""
    files = spark.read.format("binaryFile").options(**LENIENT).load(path)
    packed = files.where(F.lower("path").endswith(".gz")).select(F.col("_metadata.file_path").alias("file"), "content")
    return packed.mapInArrow(_torn, "file string, torn boolean").where("torn").select("file")


def unread_files(listed: DataFrame, given: DataFrame, promised: DataFrame | None = None) -> DataFrame:
    """The files of ``listed`` that gave no rows or fewer than they promise: its columns, then reason, rows.

    ``given`` and ``promised`` are (file, rows). A file that promises no rows and gives none is in order.
    """
    counted = listed.join(given.withColumnRenamed("rows", "_given"), "file", "left")
    rows = F.coalesce("_given", F.lit(0).cast("bigint"))
    reason = F.when(rows == 0, "not readable")
    if promised is not None:
        counted = counted.join(promised.withColumnRenamed("rows", "_promised"), "file", "left")
        reason = F.when(F.col("_promised").isNull(), reason).when(rows < F.col("_promised"), "breaks off")
    return counted.select(*listed.columns, reason.alias("reason"), rows.alias("rows")).where("reason IS NOT NULL")
