"""Page sets: overlaid page by page, or concatenated in file-name order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventdocs.operators.ordinal import running_total

#: What tells overlay pages of one number apart: their first label in code-point order goes on the page.
_OVERLAY = ("label", "page_w_mm", "page_h_mm")


def _one_per_page(overlay: DataFrame, doc: str) -> DataFrame:
    """For each (document, page) its first overlay page and how many there are; reduced before the shuffle."""
    first = F.min(F.struct(F.col("label").isNull().alias("unlabelled"), *_OVERLAY))
    counted = overlay.groupBy(doc, "page_no").agg(first.alias("first"), F.count(F.lit(1)).alias("times"))
    return counted.select(doc, "page_no", *[F.col(f"first.{c}").alias(c) for c in _OVERLAY], "times")


def page_overlay(base: DataFrame, overlay: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Page k of the overlay on page k of the base.

    Base pages beyond the overlay stay, unmarked; overlay pages beyond the base are dropped. The overlay is fitted
    into the base page's rectangle: scaled in proportion and centred. Both sides are joined on (document, page), so the
    pages of one huge document go to all tasks. Of overlay pages with the same number one is taken, before the join, so
    base pages are never doubled; ``page_overlay_rejects`` reports the others.
    """
    on_top = _one_per_page(overlay, doc).select(
        doc,
        "page_no",
        "label",
        F.col("page_w_mm").alias("_ow"),
        F.col("page_h_mm").alias("_oh"),
    )
    joined = base.join(on_top, [doc, "page_no"], "left")
    joined = joined.withColumn("scale", F.least(F.col("page_w_mm") / F.col("_ow"), F.col("page_h_mm") / F.col("_oh")))
    fitted = F.when(F.col("_ow").isNotNull() & F.col("_oh").isNotNull(), F.col("scale"))
    return joined.select(
        *base.columns,
        "label",
        fitted.alias("scale"),
        ((F.col("page_w_mm") - F.col("_ow") * fitted) / F.lit(2.0)).alias("offset_x_mm"),
        ((F.col("page_h_mm") - F.col("_oh") * fitted) / F.lit(2.0)).alias("offset_y_mm"),
    )


def page_overlay_rejects(base: DataFrame, overlay: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Overlay pages that go on no base page: (document, page_no, reason, pages), how many of them.

    "doubled" are those beyond the first of their number, "beyond the base" those whose page the base does not have, and
    "no number" those without a document or a page number.
    """
    counted = _one_per_page(overlay, doc).select(doc, "page_no", "times")
    held = base.select(doc, "page_no").distinct().withColumn("_held", F.lit(True))
    joined = counted.join(held, [doc, "page_no"], "left")
    placed = F.col(doc).isNotNull() & F.col("page_no").isNotNull()
    reason = F.when(~placed, "no number").when(F.col("_held").isNull(), "beyond the base").when(F.col("times") > 1, "doubled")
    pages = F.when(F.col("_held"), F.col("times") - 1).otherwise(F.col("times"))
    return joined.select(doc, "page_no", reason.alias("reason"), pages.alias("pages")).where("reason IS NOT NULL")


def split_unreadable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to use and files to report: an unreadable input is skipped and the rest goes on."""
    readable = F.coalesce(F.col("status") == "ok", F.lit(False))
    return files.where(readable), files.where(~readable)


BY_NAME = ("file_name", "upload_seq")
BY_LIST = ("upload_seq", "file_name")

#: Pages of a slice; one bit of a bitmap stands for each.
_SLICE_PAGES = 32768
# A missing name or place in the list is told apart from all others, and joins and sorts like a first one.
_NO_NAME, _NO_PLACE = "\0", -(1 << 63)


#: What a page says about its file: a page set belongs to one upload, or to all places where a list names the file.
BY_UPLOAD, BY_FILE = ("file_name", "upload_seq"), ("file_name",)


def _with_file_key(df: DataFrame) -> DataFrame:
    """``_name`` and ``_seq``, which are never null; without an upload_seq all pages of a name are one file."""
    seq = F.coalesce("upload_seq", F.lit(_NO_PLACE)) if "upload_seq" in df.columns else F.lit(_NO_PLACE)
    return df.withColumns({"_name": F.coalesce("file_name", F.lit(_NO_NAME)), "_seq": seq})


def _key(job: Sequence[str], by: Sequence[str]) -> list[str]:
    return [*job, *({"file_name": "_name", "upload_seq": "_seq"}[c] for c in by)]


def _slice_of_page() -> Column:
    return F.call_function("div", F.coalesce("page_no", F.lit(0)) - 1, F.lit(_SLICE_PAGES))


def _numbered_files(pages: DataFrame, readable: DataFrame, key: list[str]) -> DataFrame:
    """Readable files with their ``_pages`` and whether those are ``_whole``: numbered 1, 2, ..., each number once.

    Pages of other files are left out first. A slice of numbers has a bitmap, so equal numbers are found exactly and
    rows are combined before the shuffle.
    """
    known = _with_file_key(pages).join(readable.select(*key).distinct(), key, "left_semi")
    known = known.withColumn("_slice", _slice_of_page())
    bit = F.pmod(F.col("page_no") - 1, F.lit(_SLICE_PAGES))
    slices = known.groupBy(*key, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.bitmap_count(F.bitmap_construct_agg(bit)).alias("_distinct"),
        F.min("page_no").alias("_low"),
        F.max("page_no").alias("_high"),
    )
    files = slices.groupBy(*key).agg(
        F.sum("_rows").alias("_pages"), F.sum("_distinct").alias("_numbers"), F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
    )
    whole = (F.col("_low") == 1) & (F.col("_high") == F.col("_pages")) & (F.col("_numbers") == F.col("_pages"))
    return files.select(*key, "_pages", F.coalesce(whole, F.lit(False)).alias("_whole"))


def page_combine(
    pages: DataFrame,
    files: DataFrame,
    job: Sequence[str] = ("job_id",),
    order: Sequence[str] = BY_NAME,
    by: Sequence[str] = BY_UPLOAD,
) -> DataFrame:
    """Pages of all usable files of a job, numbered through in file-name order or in the order of the list.

    ``files`` has rows (job, file_name, upload_seq) with ``status``, each of them a place in the list. With ``by`` =
    BY_FILE pages belong to their file's name, and a file that the list names at several places comes at each of them; so
    does one of equal rows. Files of the same name keep their upload order, one without a place comes first. A file is used
    if it is readable and its pages are numbered 1, 2, ..., each once; ``page_combine_rejects`` reports everything else.
    Pages are counted per file, the counts are summed up over the places, and a page adds its own number to what comes
    before each of its file's places. The page rows meet these on (file, slice of the page number), so that one huge
    file does not end up in one task.
    """
    job = list(job)
    key = _key(job, by)
    readable, _ = split_unreadable(_with_file_key(files))
    counted = _numbered_files(pages, readable, key).where("_whole").drop("_whole")
    # Equal rows are one place that is taken several times over.
    listed = readable.groupBy(*job, "_name", "_seq").agg(F.count(F.lit(1)).alias("_times")).join(counted, key)
    listed = listed.withColumn("_taken", F.col("_pages") * F.col("_times"))
    places = [{"file_name": "_name", "upload_seq": "_seq"}[c] for c in order]
    starts = running_total(listed, job, places, "_taken", "_start")
    again = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1))
    starts = starts.withColumn("_again", again).withColumn("_before", F.col("_start") + F.col("_again") * F.col("_pages"))
    last = F.call_function("div", F.col("_pages") - 1, F.lit(_SLICE_PAGES))
    per_slice = starts.select(*key, "_before", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_slice"))
    return (
        _with_file_key(pages)
        .withColumn("_slice", _slice_of_page())
        .join(per_slice, [*key, "_slice"])
        .withColumn("out_page", F.col("_before") + F.col("page_no"))
        .select(*pages.columns, "out_page")
    )


def page_combine_rejects(
    files: DataFrame,
    pages: DataFrame | None = None,
    job: Sequence[str] = ("job_id",),
    by: Sequence[str] = BY_UPLOAD,
) -> DataFrame:
    """Report of what was skipped: unreadable files and, given the pages, files that are numbered wrongly, readable files
    without pages, and files that have pages but no place in the list; of those, columns beside the file's name are null."""
    readable, unreadable = split_unreadable(_with_file_key(files))
    reason = F.coalesce("status", F.lit("unknown"))
    skipped = unreadable.withColumn("_reason", reason)
    if pages is not None:
        key = _key(job, by)
        numbered = _numbered_files(pages, readable, key).select(*key, "_whole")
        wrong = F.when(F.col("_whole").isNull(), "no pages").when(~F.col("_whole"), "page numbers are not 1, 2, ...")
        found = readable.join(numbered, key, "left").withColumn("_reason", wrong).where("_reason IS NOT NULL")
        skipped = skipped.unionByName(found.drop("_whole"))
        # A row per file, not per page, meets the list.
        held = _with_file_key(pages).select(*key).distinct()
        unlisted = held.join(_with_file_key(files).select(*key).distinct(), key, "left_anti")
        own = {"file_name": F.nullif("_name", F.lit(_NO_NAME)), "upload_seq": F.nullif("_seq", F.lit(_NO_PLACE))}
        columns = [
            (F.col(c) if c in job else own[c] if c in by else F.lit(None)).cast(files.schema[c].dataType).alias(c)
            for c in files.columns
        ]
        unlisted = unlisted.select(*columns, F.lit("not in the list").alias("_reason"))
        skipped = skipped.select(*files.columns, "_reason").unionByName(unlisted)
    name = F.coalesce("file_name", F.lit("a file without a name"))
    message = F.concat(F.lit("skipped "), name, F.lit(": "), F.col("_reason"))
    return skipped.select(*files.columns, message.alias("message"))
