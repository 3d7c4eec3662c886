"""What the operators share: tables in the shared folder, text columns, and connected components."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventdocs.operators.ordinal import use_checkpoints

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(column: Column) -> Column:
    """A-Z lowered, every other character unchanged."""
    return F.translate(column, UPPER, UPPER.lower())


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, see ``use_checkpoints``."""
    return use_checkpoints(spark)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table written by ``new_path`` that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def drop_written(table: DataFrame) -> None:
    drop_path(table.sparkSession, table.written_to)


def with_row_key(df: DataFrame, key: str, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, row_key, text, *carry): row_key tells rows of one key with different texts apart; equal rows share it."""
    shown = text_of(text)
    return df.select(F.col(key), F.xxhash64(F.col(key), shown).alias("row_key"), shown.alias("text"), *carry)


def same_row(a: DataFrame, b: DataFrame, key: str) -> Column:
    """Join condition on (key, row_key), also for null keys."""
    return (a["row_key"] == b["row_key"]) & a[key].eqNullSafe(b[key])


#: Tables of words that a Python worker keeps from task to task: (operator, what clears them).
_kept: list[tuple[str, Callable[[], None]]] = []


def keeps(operator: str, clear: Callable[[], None]) -> None:
    """Announces a table that the operator keeps in its workers."""
    _kept.append((operator, clear))


def keep_only(operator: str) -> None:
    """Clears what other operators have kept in this worker; called where a task starts."""
    for owner, clear in _kept:
        if owner != operator:
            clear()
    release_memory()


def release_memory() -> None:
    """Gives freed memory back to the machine; a worker that waits for its next task holds no more than it keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task of ``mapInArrow`` that gives its memory back when it ends."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each value starts and the last one ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]] if len(column) else flat[:0], offsets - (offsets[0] if len(offsets) else 0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds ``most`` bytes of ``column`` or a single row."""
    for batch in batches:
        sizes = np.diff(utf8_views(batch.column(column))[1])
        start, total = 0, 0
        for row, size in enumerate(sizes):
            if row > start and total + size > most:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


#: Tasks that add up arrays of other tasks.
SUMS = 8
#: An array of a task: which of the SUMS tasks adds it up, and in which order.
ARRAYS = "slot int, task long, values binary"


def array_row(task: int, values: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary())
    row = zip(([task % SUMS], [task], [values.tobytes()]), kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in row], names=["slot", "task", "values"])


def added_up(arrays: DataFrame, kind: type = np.float64) -> np.ndarray | None:
    """Sum of arrays of one size (see ARRAYS); None without any. They are added up in the order of ``task``, so that the
    result is the same each time, and the driver gets at most SUMS of them."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, value in zip(batch.column("slot").to_pylist(), batch.column("values").to_pylist()):
                own = np.frombuffer(value, kind)
                totals[slot] = totals[slot] + own if slot in totals else own
        for slot, total in sorted(totals.items()):
            yield array_row(slot, total)

    dealt = arrays.repartition(SUMS, "slot").sortWithinPartitions("slot", "task")
    found = sorted((r["slot"], bytes(r["values"])) for r in dealt.mapInArrow(together, ARRAYS).collect())
    return sum((np.frombuffer(v, kind) for _, v in found), np.zeros((), kind)) if found else None


def summed(df: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], kind: type = np.float64) -> np.ndarray | None:
    """Sum of ``partial`` over all batches of all tasks; None without rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = partial(batch)
            total = own if total is None else total + own
        if total is not None:
            yield array_row(TaskContext.get().partitionId(), total)

    return added_up(df.mapInArrow(each, ARRAYS), kind)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` of BIGINT nodes: (node, root), root the smallest node of each.

    Alternates large-star and small-star steps, which never send a node more than its neighbours and end
    after a number of rounds that grows with the logarithm of the longest path. A hub's rows are pre-aggregated
    to one minimum per task, and the join that hands it out may be split, so no task holds a hub's whole group.
    Each round is a table in the shared folder. Loops and nulls are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = written(links, "links")
    previous = None
    while True:
        # The minima are tables of their own, so that AQE may split a hub's rows in the joins.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour goes to the smallest of the node and its neighbours.
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        smallest = written(smallest, "smallest")
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u > v").distinct(), "large-star")
        # Small star: the smaller neighbours and the node itself go to the smallest.
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        earlier, links = links, written(small, "links")
        for table in (earlier, smallest, large, least):
            drop_written(table)
        state = links.agg(
            F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.countDistinct("v")
        ).first()
        if state == previous:
            break
        previous = state
    nodes = links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = nodes.select(F.col("root").alias("node"), "root").distinct()
    return nodes.unionByName(roots)
