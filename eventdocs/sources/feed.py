"""Article feeds as XML files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventdocs.operators.ordinal import use_checkpoints
from eventdocs.schemas import FEED_ENTRY
from eventdocs.sources.files import LENIENT

# Texts keep their white space, and element names are matched without their namespace.
XML_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry, for citations that need no position in the feed.

    Where a file stops being XML, a last row without any part stands for the rest of it; see ``broken_entries``.
    """
    rows = spark.read.format("xml").options(rowTag="entry", **XML_OPTIONS).schema(FEED_ENTRY).load(path)
    return rows.select(F.col("_metadata.file_path").alias("feed_file"), "*")


def broken_entries(entries: DataFrame) -> DataFrame:
    """Rows that stand for the unreadable rest of a file."""
    return entries.where("article_title IS NULL AND article_link IS NULL AND author IS NULL")


#: Pieces of a file end here, be it the start or the end of an entry, with any prefix.
_SEPARATOR = "entry>"
_PREFIX = r"(?:[A-Za-z_][\w.-]*:)?"
_CLOSES = rf"</{_PREFIX}\z"
# What is behind the last "<" of a piece.
_TAIL_OPENS, _TAIL_CLOSES = rf"\A{_PREFIX}\z", rf"\A/{_PREFIX}\z"
# A start that has attributes or a line break stands within a piece.
_OPENS_INSIDE = rf"(?s)\A.*?<{_PREFIX}entry\s[^>]*>"
_BEFORE_ENTRY = rf"(?s)\A.*?<{_PREFIX}entry(?:\s[^>]*)?>"
_TOTAL = rf"<{_PREFIX}totalResults(?:\s[^>]*)?>\s*([0-9]+)\s*<"
_FEED_ENDS = rf"</{_PREFIX}feed\s*>"
_COMMENT = r"(?s)<!--.*?-->"
_LAST_MARK = r"(?s)\A.*(<!--|-->|<!\[CDATA\[|\]\]>)"
_BROKEN = "_broken"
_SPLIT = ("feed_file", "_block")


def _holds(text: Column, *words: str) -> Column:
    """Whether one of the words occurs; much cheaper than a pattern, which is tried only then."""
    found = [F.contains(text, F.lit(word)) for word in words]
    return reduce(lambda one, other: one | other, found)


def _without_comments(text: Column) -> Column:
    return F.when(_holds(text, "<!--"), F.regexp_replace(text, _COMMENT, "")).otherwise(text)


def _pieces(spark: SparkSession, path: str, keep: Sequence[str]) -> DataFrame:
    """The pieces of all files with the split that they start in, in the order of ``_at`` there. A large file is read by
    several tasks."""
    rows = spark.read.options(**LENIENT, lineSep=_SEPARATOR).text(path)
    value = F.col("value")
    plain = _without_comments(value)
    mark = F.nullif(F.regexp_extract("value", _LAST_MARK, 1), F.lit(""))
    tail = F.substring_index("value", "<", -1)
    return rows.select(
        F.col("_metadata.file_path").alias("feed_file"),
        *keep,
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
        F.when(_holds(value, "<!--", "-->", "<![CDATA[", "]]>"), mark).alias("_mark"),
        (_holds(value, "<") & tail.rlike(_TAIL_OPENS)).alias("_opens"),
        (_holds(value, "<") & tail.rlike(_TAIL_CLOSES)).alias("_closes"),
        (_holds(plain, "entry") & plain.rlike(_OPENS_INSIDE)).alias("_opens_inside"),
        F.when(_holds(plain, "totalResults"), F.regexp_extract(plain, _TOTAL, 1).try_cast("bigint")).alias("_total"),
        (_holds(plain, "feed") & plain.rlike(_FEED_ENDS)).alias("_ends"),
    )


def _told(pieces: DataFrame) -> DataFrame:
    """``_opens`` and ``_closes`` only where the piece does not end in a comment or in literal text; ``_mark_before`` is the
    last mark of either in earlier splits."""
    earlier = Window.partitionBy(*_SPLIT).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.coalesce(F.last("_mark", ignorenulls=True).over(earlier), F.col("_mark_before"))
    outside = F.coalesce(~state.isin("<!--", "<![CDATA["), F.lit(True))
    return pieces.withColumn("_outside", outside).withColumns(
        {"_opens": F.col("_opens") & F.col("_outside"), "_closes": F.col("_closes") & F.col("_outside")}
    )


def _splits(pieces: DataFrame) -> DataFrame:
    """One narrow row per split: what the splits before it in the file leave to it, and what is known of the file."""
    use_checkpoints(pieces.sparkSession)
    narrow = pieces.drop("value").checkpoint()
    before = Window.partitionBy("feed_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    marks = narrow.groupBy(*_SPLIT).agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_at"))).alias("_mark"))
    marks = marks.select(*_SPLIT, F.last("_mark", ignorenulls=True).over(before).alias("_mark_before"))
    told = _told(narrow.join(marks, list(_SPLIT)))
    opened = F.coalesce(F.lag("_opens").over(Window.partitionBy(*_SPLIT).orderBy("_at")), F.lit(True))
    told = told.withColumn("_began", ~F.col("_closes") & ~F.col("_ends") & (opened | F.col("_opens_inside")))
    known = F.when(F.col("_total").isNotNull() & F.col("_outside"), F.col("_at"))
    counted = told.groupBy(*_SPLIT, "_mark_before").agg(
        F.sum(F.col("_closes").cast("bigint")).alias("_entries"),
        F.min_by("_total", known).alias("_total"),
        # Whether the last piece is the start of an entry that goes on; at the end of a file, of one that breaks off.
        F.max_by(F.col("_began"), "_at").alias("_open_last"),
        F.max("_ends").alias("_ends"),
    )
    whole = Window.partitionBy("feed_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counted.select(
        *_SPLIT,
        "_mark_before",
        F.coalesce(F.sum("_entries").over(before), F.lit(0)).alias("_start"),
        F.first("_total", ignorenulls=True).over(whole).alias("totalResults"),
        F.sum("_entries").over(whole).alias("_found"),
        F.col("_open_last").alias("_unfinished"),
        F.max("_ends").over(whole).alias("_whole"),
    )


def _declared(content: Column) -> Column:
    """The entry as XML of its own: prefixes are declared, whatever they stood for."""
    names = F.array_distinct(F.regexp_extract_all(content, F.lit(r"[<\s/]([A-Za-z_][\w.-]*):[\w]"), F.lit(1)))
    names = F.filter(names, lambda n: n != "xml")
    spaces = F.array_join(F.transform(names, lambda n: F.concat(F.lit(" xmlns:"), n, F.lit('="'), n, F.lit('"'))), "")
    return F.concat(F.lit("<entry"), spaces, F.lit(">"), content, F.lit("</entry>"))


def _entries(pieces: DataFrame, splits: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every entry up to the feed's count: (feed_file, *keep, ordinal, entry), ``entry`` with its text where it is broken.

    Mostly an entry is two pieces; it is more where a comment or literal text in it looks like one."""
    told = _told(pieces.join(splits, list(_SPLIT)))
    earlier = Window.partitionBy(*_SPLIT).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.sum(F.col("_closes").cast("bigint")).over(earlier), F.lit(0))
    numbered = told.withColumn("ordinal", F.col("_start") + closed)
    numbered = numbered.where("ordinal < totalResults AND ordinal < _found")
    parts = F.array_sort(F.collect_list(F.struct("_block", "_at", "value")))
    whole = numbered.groupBy("feed_file", *keep, "ordinal").agg(F.transform(parts, lambda p: p["value"]).alias("parts"))
    text = _without_comments(F.array_join("parts", _SEPARATOR))
    content = F.regexp_replace(F.regexp_replace(text, _BEFORE_ENTRY, ""), _CLOSES, "")
    # What has no start is not readable either.
    xml = _declared(F.when(text.rlike(_BEFORE_ENTRY), content).otherwise(F.lit("<")))
    entry = F.from_xml(xml, f"{FEED_ENTRY}, {_BROKEN} STRING", {**XML_OPTIONS, "columnNameOfCorruptRecord": _BROKEN})
    return whole.select("feed_file", *keep, "ordinal", entry.alias("entry"))


def read_feed_entries(spark: SparkSession, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """Entries with their ``ordinal`` in the feed, up to the feed's own count of results. One feed per file.

    Files are read split by split, entry by entry: the number of an entry is the number of entries that end before it, counted
    per split and summed up over the file, so no feed is one value. Comments and literal text hold no entries; elements may have any
    prefix. An entry that is no XML is left out alone and keeps its number; of a file that breaks off all entries before
    are read. ``keep`` names partition columns of the folder. What is left out is in ``read_feed_rejects``. A narrow row per
    start and end of an entry is checkpointed while the plan is built.
    """
    pieces = _pieces(spark, path, keep)
    found = _entries(pieces, _splits(pieces), keep).where(F.col("entry")[_BROKEN].isNull())
    return found.select("feed_file", *keep, "ordinal", "entry.*").drop(_BROKEN)


def read_feed_rejects(spark: SparkSession, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """Files that are not read in full: ``reason``, and the number of ``entries`` that are left out by it.

    These are files without a count of results, files without entries, files that break off before the feed ends, with the
    entry that they break off in, and files with entries that are no XML. Entries beyond the count are left out on
    purpose and not reported.
    """
    pieces = _pieces(spark, path, keep)
    splits = _splits(pieces)
    files = splits.groupBy("feed_file").agg(
        *[F.first(c).alias(c) for c in ("totalResults", "_found", "_whole")],
        F.max_by("_unfinished", "_block").alias("_unfinished"),
    )
    found, total = F.col("_found"), F.col("totalResults")
    reason = (
        F.when(total.isNull(), "no count of results")
        .when(~F.col("_whole"), "breaks off")
        .when(found == 0, "no entries")
    )
    lost = F.when(total.isNull(), found).when(F.col("_unfinished") & (found < total), 1).otherwise(0)
    places = pieces.select("feed_file", *keep).distinct()
    named = files.select("feed_file", reason.alias("reason"), lost.cast("bigint").alias("entries")).where("reason IS NOT NULL")
    broken = _entries(pieces, splits, keep).where(F.col("entry")[_BROKEN].isNotNull())
    broken = broken.groupBy("feed_file", *keep).agg(F.count(F.lit(1)).alias("entries"))
    broken = broken.select("feed_file", *keep, F.lit("not readable as XML").alias("reason"), "entries")
    return places.join(named, "feed_file").select(*broken.columns).unionByName(broken)
