"""Numbered label pages, division pages and blank pages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventdocs import layout
from eventdocs.functions.geometry import mm_to_pt, with_bleed
from eventdocs.functions.text import page_label, session_label

RANGE_BLOCK = 1 << 16


def expand_range(df: DataFrame, first: str, last: str, out: str, block: int = RANGE_BLOCK) -> DataFrame:
    """One row per number of ``first``..``last`` inclusive; nothing where the range is empty. A missing bound is 1.

    Every range is cut into blocks of ``block`` numbers, and the blocks are dealt out to all tasks before they are
    written out, so that one huge range is not written by a single task.
    """
    keep = [c for c in df.columns if c not in (first, last)]
    low, high = (F.coalesce(F.col(bound).cast("bigint"), F.lit(1).cast("bigint")) for bound in (first, last))
    starts = F.when(low <= high, F.sequence(low, high, F.lit(block).cast("bigint")))
    cuts = df.select(*keep, high.alias("_high"), F.explode(starts).alias("_from"))
    dealt = cuts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cuts.columns)
    return dealt.select(
        *keep, F.explode(F.sequence("_from", F.least(F.col("_from") + (block - 1), F.col("_high")))).alias(out)
    )


def _settings(requests: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Fill in settings that are missing as a column or null."""
    page = {
        "page_w_mm": F.lit(layout.A4_WIDTH_MM),
        "page_h_mm": F.lit(layout.A4_HEIGHT_MM),
        "bleed_mm": F.lit(3.0),
        "font_name": F.lit(layout.FONT_NAME),
    }
    filled = {}
    for name, default in {**page, **defaults}.items():
        filled[name] = F.coalesce(F.col(name), default) if name in requests.columns else default
    out = requests.withColumns(filled)
    return out.withColumns(
        {
            "page_w_mm": with_bleed(F.col("page_w_mm"), F.col("bleed_mm")).cast("double"),
            "page_h_mm": with_bleed(F.col("page_h_mm"), F.col("bleed_mm")).cast("double"),
        }
    )


def _label_pages(placed: DataFrame, key: str, label: Column, align: str) -> DataFrame:
    pages = expand_range(placed, "start", "end", "number")
    return pages.select(
        key,
        "number",
        (F.col("number") - F.col("_first") + 1).alias("page_no"),
        label.alias("label"),
        F.col("x_mm").cast("double"),
        F.col("y_mm").cast("double"),
        mm_to_pt(F.col("x_mm")).alias("x_pt"),
        mm_to_pt(F.col("y_mm")).alias("y_pt"),
        "page_w_mm",
        "page_h_mm",
        F.col("font_size").cast("double"),
        "font_name",
        F.lit(align).alias("align"),
    )


def session_labels(requests: DataFrame, key: str) -> DataFrame:
    """Pages with a session number, left aligned, placed from the top-left; bleed shifts both x and y."""
    defaults = {
        "start": F.lit(1).cast("bigint"),
        "end": F.lit(1).cast("bigint"),
        "pre": F.lit("A"),
        "post": F.lit(""),
        "x_mm": F.lit(20.0),
        "y_mm": F.lit(20.0),
        "font_size": F.lit(30.0),
    }
    placed = _settings(requests, defaults).withColumns(
        {
            "x_mm": F.col("x_mm") + F.col("bleed_mm"),
            "y_mm": F.col("page_h_mm") - (F.col("y_mm") + F.col("bleed_mm")),
            "_first": F.col("start"),
        }
    )
    return _label_pages(placed, key, session_label(F.col("pre"), F.col("number"), F.col("post")), "left")


def page_labels(requests: DataFrame, key: str) -> DataFrame:
    """Pages with a page number, centred on x (the page's middle by default), placed from the bottom.

    Bleed shifts y; an x that is given stays as it is.
    """
    defaults = {
        "start": F.lit(1).cast("bigint"),
        "end": F.lit(1).cast("bigint"),
        "pre": F.lit("- "),
        "post": F.lit(" -"),
        "x_mm": F.lit(None).cast("double"),
        "y_mm": F.lit(10.0),
        "font_size": F.lit(None).cast("double"),
    }
    placed = _settings(requests, defaults).withColumns(
        {
            "x_mm": F.coalesce(F.col("x_mm"), F.col("page_w_mm") / F.lit(2.0)),
            "y_mm": F.col("y_mm") + F.col("bleed_mm"),
            "_first": F.col("start"),
        }
    )
    return _label_pages(placed, key, page_label(F.col("pre"), F.col("number"), F.col("post")), "center")


def page_requests(requests: DataFrame, key: str) -> DataFrame:
    """Single pages: a ``division`` page has a filled strip with centred text, a ``blank`` page may be filled.

    The strip's position is given from the top and returned from the bottom; its text sits in the strip's middle,
    lowered by 0.4 of the font size.
    """
    defaults = {
        "bleed_mm": F.when(F.col("kind") == "blank", 0.0).otherwise(3.0),
        "text": F.lit(""),
        "x_mm": F.lit(None).cast("double"),
        "y_mm": F.lit(10.0),
        "height_mm": F.lit(40.0),
        "font_size": F.lit(None).cast("double"),
        "fill_color": F.lit(None).cast("string"),
    }
    c = F.col
    pages = _settings(requests, defaults).withColumn(
        "strip_y_mm", c("page_h_mm") - (c("y_mm") + c("bleed_mm") + c("height_mm"))
    )
    division, blank = c("kind") == "division", c("kind") == "blank"
    middle_mm = c("strip_y_mm") + c("height_mm") / F.lit(2.0)
    return pages.select(
        key,
        "kind",
        "page_w_mm",
        "page_h_mm",
        F.when(division, c("strip_y_mm")).cast("double").alias("strip_y_mm"),
        F.when(division, c("page_w_mm")).alias("strip_w_mm"),
        F.when(division, c("height_mm")).cast("double").alias("strip_h_mm"),
        F.when(division, c("text")).alias("text"),
        F.when(division, F.coalesce(c("x_mm"), c("page_w_mm") / F.lit(2.0))).cast("double").alias("text_x_mm"),
        F.when(division, mm_to_pt(middle_mm) - c("font_size") * F.lit(0.4)).alias("text_y_pt"),
        F.when(division, c("font_size")).cast("double").alias("font_size"),
        F.when(division, c("font_name")).alias("font_name"),
        F.when(division, F.lit(layout.STRIP_COLOR)).alias("strip_color"),
        F.when(division, F.lit(layout.STRIP_TEXT_COLOR)).alias("text_color"),
        F.when(blank, c("fill_color")).alias("fill_color"),
    )
