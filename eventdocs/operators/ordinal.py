"""Row numbers and running totals that hold when one group owns a large share of all rows.

A plain ``row_number`` over a group sorts the whole group in one task. Here a group is cut into slices of the
order key first, slices are numbered in parallel, and each slice starts where the slices before it end. Where keys
repeat, heavy slices are cut again by a tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A slice is 2**16 neighbouring keys, a block is 2**24 neighbouring slices; a BIGINT has 2**24 blocks.
SLICE_BITS, BLOCK_BITS = 16, 24
_LOWEST = -(1 << 63)
# Rows that one task sorts or counts at a time; of more rows more parts are made.
_PART_ROWS = 1 << 18


def slice_of(key: str, bits: int = SLICE_BITS) -> Column:
    """Slice number of a BIGINT key: keys share it when they agree above the lowest ``bits`` bits.

    Never null, so that joins on it need no filter and the passes over one table stay shareable.
    """
    return F.shiftright(F.coalesce(F.col(key).cast("bigint"), F.lit(_LOWEST)), bits)


def _before(value: str, group: Sequence[str], order: Sequence[str]) -> Column:
    """Sum of ``value`` over the earlier rows of the group."""
    earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def _or_unplaced(position: Column, keys: Sequence[str]) -> Column:
    """The position, or a failed job where a key is null: rows are neither dropped nor placed at random."""
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    message = F.lit(f"null in {list(keys)}: row has no place in the order")
    return F.when(known, position).otherwise(F.raise_error(message).cast("bigint"))


def slice_starts(
    df: DataFrame, group: Sequence[str], key: str, bits: int = SLICE_BITS, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """One row per (group, slice): ``_slice``, and ``_start`` = number of rows in the group's earlier slices.

    Slices are summed up within blocks and blocks within the group, so no window sees more than 2**24 of these
    narrow rows, however large or sparse the group is.
    """
    group = list(group)
    slices = df.groupBy(*group, slice_of(key, bits).alias("_slice")).agg(F.count(F.lit(1)).alias("_rows"))
    return _starts_of(slices, group, block_bits)


def _starts_of(slices: DataFrame, group: list[str], block_bits: int = BLOCK_BITS) -> DataFrame:
    """``slice_starts`` of counted slices: (*group, _slice, _rows)."""
    slices = slices.withColumn("_block", F.shiftright("_slice", block_bits))
    slices = slices.withColumn("_in_block", _before("_rows", [*group, "_block"], ["_slice"]))
    blocks = slices.groupBy(*group, "_block").agg(F.max(F.col("_in_block") + F.col("_rows")).alias("_block_rows"))
    blocks = blocks.select(*group, "_block", _before("_block_rows", group, ["_block"]).alias("_block_start"))
    return slices.join(blocks, [*group, "_block"]).select(
        *group, "_slice", (F.col("_block_start") + F.col("_in_block")).alias("_start")
    )


def dense_ordinal(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    out: str,
    bits: int = SLICE_BITS,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... in ``key`` order within each group.

    ``key`` is a BIGINT unique within its group, so a slice holds at most 2**bits rows. The rows are shuffled
    once, on (group, slice), and the join with the slice starts keeps that partitioning. A null group or key has
    no place in the order and fails the job.
    """
    group = list(group)
    starts = slice_starts(df, group, key, bits, block_bits)
    in_slice = Window.partitionBy(*group, "_slice").orderBy(key)
    return (
        df.withColumn("_slice", slice_of(key, bits))
        .withColumn("_rank", F.row_number().over(in_slice) - 1)
        .join(starts, [*group, "_slice"], "left")
        .withColumn(out, _or_unplaced(F.col("_start") + F.col("_rank"), [*group, key]))
        .select(*df.columns, out)
    )


def doubled_keys(df: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Keys that stand on more than one row of their group, null included, and how often: (*group, key, times)."""
    return df.groupBy(*group, key).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def tied_ordinal(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    out: str,
    tie: str | None = None,
    most: int = 1 << SLICE_BITS,
    bits: int = SLICE_BITS,
    tie_bits: int = SLICE_BITS,
) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... in the order of (key, tie) within each group, however often a key occurs.

    Rows of one key follow the BIGINT ``tie``, by default a hash of their other columns; rows that share both follow their
    other columns, from left to right, so the order is always defined. A null key or tie comes first; a null group fails the
    job. A slice of neighbouring keys is numbered by one task, as in ``dense_ordinal``. One with more than ``most`` rows is cut
    again, by key and by slices of the tie, and the counts of these cells are carried on; rows that are equal in every
    column are numbered as one. So no task sorts more than the rows that share a key and a slice of the tie. Columns
    have to be orderable. One narrow job runs while the plan is built: it counts the slices, which tells the heavy ones, and
    how many parts the rows are dealt out to, so that a task's share does not grow with the table.
    """
    group = list(group)
    use_checkpoints(df.sparkSession)
    others = [c for c in df.columns if c not in (*group, key, tie)]
    by_tie = F.col(tie).cast("bigint") if tie else F.xxhash64(*others, key)
    placed = df.withColumns({"_slice": slice_of(key, bits), "_tie": by_tie})
    counts = placed.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_rows")).checkpoint()
    is_heavy = F.col("_rows") > most
    rows = F.coalesce(F.sum("_rows"), F.lit(0))
    total, in_heavy = counts.agg(rows, F.coalesce(F.sum(F.when(is_heavy, F.col("_rows"))), F.lit(0))).first()
    starts = _starts_of(counts, group)
    heavy = counts.where(is_heavy).select(*group, "_slice")
    light = placed.join(heavy, [*group, "_slice"], "left_anti") if in_heavy else placed
    light = _dealt(light, total - in_heavy, [*group, "_slice"])
    in_slice = Window.partitionBy(*group, "_slice").orderBy(key, "_tie", *others)
    ranked = light.withColumn("_rank", F.row_number().over(in_slice) - 1).join(starts, [*group, "_slice"], "left")
    kept = [*df.columns, "_start", "_rank"]
    ranked = ranked.select(*kept)
    if in_heavy:
        crowded = placed.join(heavy, [*group, "_slice"], "left_semi")
        ranked = ranked.unionByName(_ranked_by_cells(crowded, in_heavy, group, key, others, tie_bits, starts).select(*kept))
    return ranked.withColumn(out, _or_unplaced(F.col("_start") + F.col("_rank"), group)).select(*df.columns, out)


def _dealt(rows: DataFrame, count: int, keys: list[str]) -> DataFrame:
    """The rows by ``keys`` in as many parts as ``count`` rows need, if those are more than the session's."""
    parts = -(-count // _PART_ROWS)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _ranked_by_cells(
    rows: DataFrame, count: int, group: list[str], key: str, others: list[str], tie_bits: int, slices: DataFrame
) -> DataFrame:
    """``_start`` of every row's slice, from ``slices``, and its ``_rank`` there, by cells of one key and neighbouring ties."""
    columns = rows.columns
    # A null key is told from the lowest one, so that cells can be joined.
    marked = rows.withColumns(
        {"_known": F.col(key).isNotNull(), "_key": F.coalesce(F.col(key), F.lit(_LOWEST)), "_cell": slice_of("_tie", tie_bits)}
    )
    owner = [*group, "_slice"]
    cell = [*owner, "_known", "_key", "_cell"]
    marked = _dealt(marked, count, cell)
    cells = marked.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows"))
    equal = marked.groupBy(*columns, "_known", "_key", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_block", F.shiftright("_cell", BLOCK_BITS))
    block = [*owner, "_known", "_key", "_block"]
    cells = _dealt(cells, count, block).withColumn("_in_block", _before("_rows", block, ["_cell"]))
    blocks = cells.groupBy(*block).agg(F.sum("_rows").alias("_block_rows"))
    blocks = _dealt(blocks, count, owner)
    blocks = blocks.select(*block, _before("_block_rows", owner, ["_known", "_key", "_block"]).alias("_block_start"))
    # The slice's start comes along with the cell's, so that the rows need no join of their own for it.
    blocks = blocks.join(slices, owner, "left")
    starts = cells.join(blocks, block).select(*cell, "_start", (F.col("_block_start") + F.col("_in_block")).alias("_cell_start"))
    first = F.col("_cell_start") + _before("_n", cell, ["_tie", *others])
    columns = [*columns, "_start"]
    ranked = equal.join(starts, cell).withColumn("_rank", first).select(*columns, "_n", "_rank")
    # Copies of a row are dealt out in parts before they are written out.
    part, size = F.col("_copies"), 1 << SLICE_BITS
    copies = ranked.where("_n > 1").withColumn(
        "_copies", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("_n") - 1, F.lit(size))))
    )
    copies = copies.repartition(*owner, "_rank", "_copies")
    copies = copies.withColumn(
        "_copy", F.explode(F.sequence(part * size, F.least(F.col("_n"), (part + 1) * size) - 1))
    ).withColumn("_rank", F.col("_rank") + F.col("_copy"))
    kept = [*columns, "_rank"]
    return ranked.where("_n = 1").select(*kept).unionByName(copies.select(*kept))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the earlier rows of the group, for order keys of any type.

    The rows are range partitioned on (group, order) and that placement is checkpointed, so every later step
    sees the same parts. A part adds up on its own; only one row per (part, group) is summed across parts.
    (group, order) has to be unique.
    """
    group, order = list(group), list(order)
    spark = df.sparkSession
    use_checkpoints(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    )
    carried = placed.groupBy(*group, "_part").agg(F.sum(value).alias("_part_total"))
    carried = carried.select(*group, "_part", _before("_part_total", group, ["_part"]).alias("_carried"))
    return (
        placed.withColumn("_local", _before(value, [*group, "_part"], order))
        .join(carried, [*group, "_part"], "left")
        .withColumn(out, _or_unplaced(F.col("_carried") + F.col("_local"), group))
        .select(*df.columns, out)
    )


def use_checkpoints(spark: SparkSession) -> str:
    """Checkpoint folder of the session: the shared one that it names. On one machine it may name none, and one beside the
    warehouse serves; on a cluster that might be a machine's own, so there it is an error."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()
