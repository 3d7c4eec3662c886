"""Fixed values of the printed documents: page sizes, grids, element positions, texts.

Lengths are millimetres, y grows upwards from the bottom of the sheet, and element offsets count from the
top-left corner of a badge or receipt.
"""

from __future__ import annotations

from typing import NamedTuple

# Page sizes (width, height).
PAGE_SIZES_MM = {"A3": (297.0, 420.0), "A4": (210.0, 297.0), "A5": (148.0, 210.0)}
A4_WIDTH_MM, A4_HEIGHT_MM = PAGE_SIZES_MM["A4"]

# Ten badges to an A4 sheet, filled down the left column and then down the right one.
BADGES_PER_SHEET = 10
BADGES_PER_COLUMN = 5
BADGE_LEFT_MM, BADGE_TOP_MM = 14, 286
BADGE_STEP_X_MM, BADGE_STEP_Y_MM = 91, 55

# Up to three receipts to a page, one under another.
RECEIPT_LEFT_MM, RECEIPT_TOP_MM, RECEIPT_STEP_Y_MM = 14, 286, 70

# Two columns of at most eight footer lines; the first line hangs out to the left.
FOOTER_MAX_LINES = 8
FOOTER_TOP_MM, FOOTER_STEP_MM = 47, 5
FOOTER_FONT_SIZE = 11.0
FOOTER_COLUMNS_MM = {1: (10, 15), 2: (125, 130)}

# Affiliation text shrinks to this width, and never grows beyond this size.
AFFILIATION_FIT_WIDTH, AFFILIATION_MAX_SIZE = 210.0, 20.0

# Printed texts.
DINNER_MARK, WORKSHOP_MARK = "懇", "研"
AMOUNT_PREFIX, AMOUNT_SUFFIX = "￥", "－"
RECIPIENT_SUFFIX = " 様"
PROVISO_PREFIX, PROVISO_SUFFIX = "ただし，", "として"
RECEIVED_TEXT = "上記正に領収いたしました。"
BLANK_NAME = " " * 16
BLANK_AMOUNT = "￥" + " " * 14
FEE_LABELS = ("参加費", "懇親会参加費", "研修会参加費")
BLANK_FEE_LABELS = ("参加費", "懇親会参加費", "現地研修会参加費")

# The font of all texts, and the colours of a division page's strip and of its text.
FONT_NAME = "GenShinGothic"
STRIP_COLOR, STRIP_TEXT_COLOR = "black", "white"

# The stamp is printed this wide and keeps its proportions.
STAMP_WIDTH_MM = 22.0


class Element(NamedTuple):
    """One thing drawn on a badge or receipt, placed from its top-left corner."""

    name: str
    kind: str
    dx: float
    dy: float
    font_size: float | None = None
    color: str | None = None
    align: str | None = None
    shape: str | None = None
    bg_color: str | None = None
    width: float | None = None
    height: float | None = None
    line_width: float | None = None


# What a badge shows. The affiliation's size and the strip's colour depend on the row.
BADGE_ELEMENTS = (
    Element("congress", "text", 1, -10, 14, "white", "left", "rect", None, 91),
    Element("place", "text", 65, -10, 7, "white", "left"),
    Element("date", "text", 65, -6, 7, "white", "left"),
    Element("label_affiliation", "text", 2, -15, 6, "black", "left"),
    Element("label_name", "text", 2, -30, 6, "black", "left"),
    Element("rule_affiliation", "line", 2, -25, width=78),
    Element("rule_name", "line", 2, -40, width=78),
    Element("affiliation", "text", 2, -24, None, "black", "left"),
    Element("name", "text", 2, -39, 24, "black", "left"),
    Element("dinner_mark", "text", 5, -47, 12, "white", "left", "circle", "red"),
    Element("workshop_mark", "text", 12, -47, 12, "white", "left", "circle", "blue"),
    Element("committee", "text", 45, -45, 6, "black", "left"),
    Element("committee_sub", "text", 45, -48, 6, "black", "left"),
)

# What a receipt shows. The stamp's height depends on its image.
RECEIPT_ELEMENTS = (
    Element("stamp", "image", 140, -65, width=STAMP_WIDTH_MM),
    Element("frame", "frame", 0, -66, width=182, height=66, line_width=0.2),
    Element("title", "text", 42, -7, 12, "black", "center", None, None, 98),
    Element("recipient", "text", 42, -15, 13, "black", "center", "underlined", None, 98, None, 0.3),
    Element("amount", "text", 42, -28, 13, "black", "center", "rect", "lightgrey", 98),
    Element("proviso", "text", 42, -39, 10, "black", "center", "underlined", None, 98, None, 0.3),
    Element("date", "text", 45, -45, 10, "black", "left"),
    Element("received", "text", 45, -48.5, 10, "black", "left"),
    Element("committee_sub", "text", 105, -58, 10, "black", "left"),
    Element("president", "text", 118, -61.5, 10, "black", "left"),
)
