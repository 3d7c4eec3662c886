"""Document tables and texts as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventdocs.operators.ordinal import running_total, slice_of

BADGE_ORDER = ("sheet_no", "slot_no", "element_no")
RECEIPT_ORDER = ("entry_no", "slot_no", "element_no")


#: A write replaces the folders that it has rows for, all at once when it ends, and leaves the others.
REPLACE = {"partitionOverwriteMode": "dynamic"}


def write_by_event(df: DataFrame, path: str, order: Sequence[str], event: str = "event_id") -> None:
    """One folder per event. Rows of an event are brought together, except that Spark splits the large ones.

    Rows are sorted within a file; the order columns in the table tell the order across files. What is there of these
    events is replaced, so writing again changes nothing; other events stay, and so does an event without rows.
    """
    order = [c for c in order if c in df.columns]
    gathered = df.hint("rebalance", event).sortWithinPartitions(event, *order)
    gathered.write.partitionBy(event).mode("overwrite").options(**REPLACE).parquet(path)


#: Bytes of a list's part file, and the bits of an item's number that one slice of a list spans. Files that are asked to be
#: smaller become larger, up to PART_BYTES, where there would be more than MOST_PARTS of them: each is a task's report.
PART_BYTES, SLICE_BITS, MOST_PARTS = 1 << 27, 8, 512


def write_html_list(
    items: DataFrame, path: str, group: str, order: str = "item_index", part_bytes: int = PART_BYTES
) -> None:
    """List items as text: a folder per ``group``, with items in order within files and across the files' names.

    Slices of 2**SLICE_BITS neighbouring numbers are dealt out to tasks by the bytes before them, over all lists, so a task
    writes about ``part_bytes``: a share of a long list, or many short lists. With very many parts they are larger than asked, see
    MOST_PARTS. The bytes are summed up on narrow rows. What is there of these lists is replaced as a whole; other lists stay.
    """
    sliced = items.select(group, order, "value").withColumn("_slice", slice_of(order, SLICE_BITS))
    bytes_ = F.sum(F.octet_length("value") + F.lit(1).cast("bigint")).alias("_bytes")
    slices = sliced.groupBy(group, "_slice").agg(bytes_).withColumn("_lists", F.lit(0))
    placed = running_total(slices, ["_lists"], [group, "_slice"], "_bytes", "_before")
    placed = placed.select(group, "_slice", "_before").checkpoint()
    last = placed.agg(F.coalesce(F.max("_before"), F.lit(0))).first()[0]
    size = max(part_bytes, min(PART_BYTES, last // MOST_PARTS + 1))
    parts = last // size + 1
    placed = placed.select(group, "_slice", F.call_function("div", "_before", F.lit(size)).alias("_part"))
    same = sliced["_slice"].eqNullSafe(placed["_slice"]) & sliced[group].eqNullSafe(placed[group])
    dealt = sliced.join(placed, same, "left").select(sliced[group], sliced[order], "value", "_part")
    dealt = dealt.repartitionById(parts, F.col("_part").cast("int")).sortWithinPartitions(group, order)
    dealt.select("value", group).write.partitionBy(group).mode("overwrite").options(**REPLACE).text(path)


# A missing part is told from an empty one, and white space is kept; quotes in a text are doubled.
CONTENTS_CSV = {
    "header": "true",
    "escape": '"',
    "nullValue": r"\N",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_contents_rows(rows: DataFrame, path: str, key: str) -> None:
    """Scraped rows as CSV, four texts per item after the page key and position."""
    columns = [key, "pos", "section", "title", "author", "add_info"]
    rows.select(*columns).write.mode("overwrite").options(**CONTENTS_CSV).csv(path)
