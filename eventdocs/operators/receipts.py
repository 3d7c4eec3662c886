"""Receipts: one page per attendee with a receipt for every fee paid, and the elements drawn on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventdocs import layout
from eventdocs.functions.geometry import stamp_height_mm
from eventdocs.functions.text import amount_text, proviso_text, recipient_text
from eventdocs.operators.constants import with_constants
from eventdocs.operators.elements import expand_elements
from eventdocs.operators.ordinal import tied_ordinal
from eventdocs.schemas import FEE_COLUMNS

_EVENT = "event_id title congress committee_sub president receipt_date image_width image_height".split()
_ITEM = ["event_id", "entry_no", "slot_no", "x_mm", "y_mm", "recipient", "amount_text", "fee_label"]


def fee_items(roster: DataFrame, labels: Sequence[str] = layout.FEE_LABELS) -> DataFrame:
    """Long form of the roster: one row per attendee and non-zero fee. A missing fee is no fee.

    Fees are called by ``labels``, or by the roster's own ``fee_labels`` where it has that column.
    """
    own = [column for column in roster.columns if column == "fee_labels"]
    names = F.col("fee_labels") if own else F.array(*[F.lit(text) for text in labels])
    position = F.array_position(F.array(*[F.lit(fee) for fee in FEE_COLUMNS]), F.col("fee"))
    return (
        roster.unpivot(["event_id", "entry_no", "name", *own], list(FEE_COLUMNS), "fee", "amount")
        .where(F.col("amount") != 0)
        .withColumns({"slot_no": position - 1, "fee_label": F.element_at(names, position.cast("int"))})
        .select("event_id", "entry_no", "name", "slot_no", "fee", "amount", "fee_label")
    )


def _slot_corner(slot: Column) -> dict[str, Column]:
    return {
        "x_mm": F.lit(layout.RECEIPT_LEFT_MM).cast("bigint"),
        "y_mm": layout.RECEIPT_TOP_MM - layout.RECEIPT_STEP_Y_MM * slot,
    }


def receipt_items(roster: DataFrame, labels: Sequence[str] = layout.FEE_LABELS) -> DataFrame:
    """One receipt per attendee and non-zero fee, in the fee's place on the attendee's page."""
    return (
        fee_items(roster, labels)
        .withColumns(_slot_corner(F.col("slot_no")))
        .withColumns({"recipient": recipient_text(F.col("name")), "amount_text": amount_text(F.col("amount"))})
        .select(*_ITEM)
    )


def with_proviso(items: DataFrame, events: DataFrame) -> DataFrame:
    """Receipts with the proviso that names the event and the fee."""
    named = with_constants(items, events.select("event_id", "congress"))
    return named.select(*_ITEM, proviso_text(F.col("congress"), F.col("fee_label")).alias("proviso"))


def receipt_pages(roster: DataFrame) -> DataFrame:
    """Every attendee has a page, also one without any receipt on it; pages follow roster order."""
    paid = [F.coalesce((F.col(fee) != 0).cast("bigint"), F.lit(0)) for fee in FEE_COLUMNS]
    attendees = roster.select("event_id", "entry_no", "name", (paid[0] + paid[1] + paid[2]).alias("receipts"))
    numbered = tied_ordinal(attendees, ["event_id"], "entry_no", "_ordinal")
    return numbered.select("event_id", "entry_no", (F.col("_ordinal") + 1).alias("page_no"), "name", "receipts")


def footer_lines(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Both footers of every row, eight lines at most each; empty lines keep their place."""

    def column(side: int) -> Column:
        first_mm, other_mm = layout.FOOTER_COLUMNS_MM[side]
        given = F.coalesce(F.col(f"footer_{side}"), F.array().cast("array<string>"))
        lines = F.slice(given, 1, layout.FOOTER_MAX_LINES)
        return F.transform(
            lines,
            lambda text, i: F.struct(
                F.lit(side).cast("bigint").alias("side"),
                i.cast("bigint").alias("line_no"),
                F.when(i == 0, first_mm).otherwise(other_mm).cast("bigint").alias("x_mm"),
                (layout.FOOTER_TOP_MM - layout.FOOTER_STEP_MM * i).cast("bigint").alias("y_mm"),
                F.lit(layout.FOOTER_FONT_SIZE).alias("font_size"),
                text.alias("text"),
            ),
        )

    lines = F.concat(*[column(side) for side in sorted(layout.FOOTER_COLUMNS_MM)])
    return rows.select(*keep, F.explode(lines).alias("line")).select(*keep, "line.*")


def receipt_footers(roster: DataFrame, events: DataFrame) -> DataFrame:
    """Footer lines of every attendee's page."""
    pages = with_constants(roster.select("event_id", "entry_no"), events.select("event_id", "footer_1", "footer_2"))
    return footer_lines(pages, ["event_id", "entry_no"])


def receipt_blank(events: DataFrame) -> DataFrame:
    """Blank receipts for walk-in attendees, for the fees in each event's ``items`` list, without a stamp."""
    slots = F.array(
        *[
            F.struct(F.lit(slot).cast("bigint").alias("slot_no"), F.lit(label).alias("fee_label"))
            for slot, label in enumerate(layout.BLANK_FEE_LABELS)
        ]
    )
    chosen = F.filter(slots, lambda s: F.array_contains(F.col("items"), s["fee_label"]))
    return (
        events.select("event_id", "congress", F.explode(chosen).alias("s"))
        .select("event_id", "congress", "s.*")
        .withColumns(_slot_corner(F.col("slot_no")))
        .select(
            "event_id",
            F.lit(0).cast("bigint").alias("entry_no"),
            "slot_no",
            "x_mm",
            "y_mm",
            recipient_text(F.lit(layout.BLANK_NAME)).alias("recipient"),
            F.lit(layout.BLANK_AMOUNT).alias("amount_text"),
            "fee_label",
            proviso_text(F.col("congress"), F.col("fee_label")).alias("proviso"),
        )
    )


def receipt_blank_footers(events: DataFrame) -> DataFrame:
    """Footer lines of every event's blank page."""
    return footer_lines(events, ["event_id"])


def receipt_elements(items: DataFrame, events: DataFrame, stamped: bool = True) -> DataFrame:
    """What is drawn for every receipt: up to ten elements, the stamp only where the event has an image."""
    has_image = F.coalesce((F.col("image_width") > 0) & (F.col("image_height") > 0), F.lit(False))
    height = stamp_height_mm(F.col("image_width"), F.col("image_height"))
    rows = with_constants(items, events.select(*_EVENT)).withColumns(
        {
            "proviso": proviso_text(F.col("congress"), F.col("fee_label")),
            "stamp_height": F.when(has_image & F.lit(stamped), height),
        }
    )
    texts = {
        "title": "title",
        "recipient": "recipient",
        "amount": "amount_text",
        "proviso": "proviso",
        "date": "receipt_date",
        "received": f"'{layout.RECEIVED_TEXT}'",
        "committee_sub": "committee_sub",
        "president": "president",
    }
    overrides = {("stamp", "height"): "stamp_height"}
    conditions = {"stamp": "stamp_height IS NOT NULL"}
    keep = ["event_id", "entry_no", "slot_no"]
    return expand_elements(rows, keep, layout.RECEIPT_ELEMENTS, texts, overrides, conditions)
