"""Badges: ten to a sheet in roster order, and the elements drawn on each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventdocs import layout
from eventdocs.functions.text import fit_font_size, is_marked
from eventdocs.operators.constants import with_constants
from eventdocs.operators.elements import expand_elements
from eventdocs.operators.numbering import expand_range
from eventdocs.operators.ordinal import tied_ordinal

_EVENT = "event_id congress event_date committee committee_sub place label_affiliation label_name strip_color".split()
_BADGE = ["event_id", "entry_no", "name", "affiliation", "fee_dinner", "fee_workshop"]


def _placed(numbered: DataFrame) -> DataFrame:
    """Sheet, slot and slot corner of the badge with ordinal ``ord``."""
    per_sheet, per_column = layout.BADGES_PER_SHEET, layout.BADGES_PER_COLUMN
    return numbered.withColumns(
        {"sheet_no": F.expr(f"ord div {per_sheet}"), "slot_no": F.col("ord") % per_sheet}
    ).withColumns(
        {
            "x_mm": layout.BADGE_LEFT_MM + layout.BADGE_STEP_X_MM * F.expr(f"slot_no div {per_column}"),
            "y_mm": layout.BADGE_TOP_MM - layout.BADGE_STEP_Y_MM * (F.col("slot_no") % per_column),
        }
    )


def _laid_out(numbered: DataFrame) -> DataFrame:
    return _placed(numbered).select(
        "event_id",
        "entry_no",
        "sheet_no",
        "slot_no",
        "x_mm",
        "y_mm",
        "name",
        "affiliation",
        fit_font_size(F.col("affiliation")).alias("affil_font"),
        is_marked(F.col("fee_dinner")).alias("dinner_mark"),
        is_marked(F.col("fee_workshop")).alias("workshop_mark"),
    )


def badge_layout(roster: DataFrame) -> DataFrame:
    """One badge per attendee, numbered in roster order within the event. Attendees of one entry number follow their other
    columns' hash; ``ordinal.doubled_keys`` reports such numbers."""
    return _laid_out(tied_ordinal(roster.select(*_BADGE), ["event_id"], "entry_no", "ord"))


def badge_sheets(roster: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Sheets per event.

    Output closes a page after every full sheet and once more at the end, so ``pages_emitted`` counts a blank
    last page when the attendees fill their sheets exactly. With ``events``, an event without attendees counts too.
    """
    counts = roster.groupBy("event_id").agg(F.count(F.lit(1)).alias("badges"))
    if events is not None:
        counts = events.select("event_id").join(counts, "event_id", "left")
        counts = counts.withColumn("badges", F.coalesce("badges", F.lit(0)))
    per_sheet = layout.BADGES_PER_SHEET
    return counts.select(
        "event_id",
        "badges",
        F.expr(f"(badges + {per_sheet - 1}) div {per_sheet}").alias("sheets_needed"),
        (F.expr(f"badges div {per_sheet}") + 1).alias("pages_emitted"),
    )


def badge_blank(events: DataFrame) -> DataFrame:
    """Empty badges for ``n_sheet`` whole sheets per event; ``entry_no`` is the ordinal."""
    slots = events.select(
        "event_id",
        F.lit(0).cast("bigint").alias("first"),
        (F.coalesce("n_sheet", F.lit(1)).cast("bigint") * layout.BADGES_PER_SHEET - 1).alias("last"),
    )
    badges = expand_range(slots, "first", "last", "ord").select(
        "event_id",
        "ord",
        F.col("ord").alias("entry_no"),
        F.lit("").alias("name"),
        F.lit("").alias("affiliation"),
        F.lit(0).alias("fee_dinner"),
        F.lit(0).alias("fee_workshop"),
    )
    return _laid_out(badges)


def badge_elements(badges: DataFrame, events: DataFrame) -> DataFrame:
    """What is drawn for every badge of a layout: up to thirteen elements."""
    rows = with_constants(badges, events.select(*_EVENT))
    texts = {
        "congress": "congress",
        "place": "place",
        "date": "event_date",
        "label_affiliation": "label_affiliation",
        "label_name": "label_name",
        "affiliation": "affiliation",
        "name": "name",
        "dinner_mark": f"'{layout.DINNER_MARK}'",
        "workshop_mark": f"'{layout.WORKSHOP_MARK}'",
        "committee": "committee",
        "committee_sub": "committee_sub",
    }
    overrides = {("congress", "bg_color"): "coalesce(strip_color, 'green')", ("affiliation", "font_size"): "affil_font"}
    conditions = {
        "affiliation": "affil_font IS NOT NULL",
        "dinner_mark": "dinner_mark",
        "workshop_mark": "workshop_mark",
    }
    keep = ["event_id", "entry_no", "sheet_no", "slot_no"]
    return expand_elements(rows, keep, layout.BADGE_ELEMENTS, texts, overrides, conditions)
