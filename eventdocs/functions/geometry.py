"""Positions and boxes as column arithmetic. Millimetres are primary, points are what a renderer draws in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventdocs import layout


def mm_to_pt(length_mm: Column) -> Column:
    return length_mm * F.lit(72.0) / F.lit(25.4)


def with_bleed(length_mm: Column, bleed_mm: Column) -> Column:
    """Page side with bleed on both ends."""
    return length_mm + bleed_mm * F.lit(2.0)


def stamp_height_mm(image_width: Column, image_height: Column) -> Column:
    return F.lit(layout.STAMP_WIDTH_MM) * image_height / image_width


# Where a text is drawn: centred texts are anchored at the middle of their width, others at their left end.
TEXT_X_PT = "CASE WHEN align = 'center' THEN x_pt + w_pt * 0.5D ELSE x_pt END"

# What is drawn with a text: a rectangle or circle filled behind it, or a rule under it.
TEXT_BOX = """CASE WHEN bg_color <> 'white' AND shape = 'rect' THEN 'rect'
    WHEN bg_color <> 'white' AND shape = 'circle' THEN 'circle'
    WHEN shape = 'underlined' THEN 'underline' END"""

# A rectangle starts half a font size to the left of and below the text, a circle is given by its centre and
# radius, an underline runs from its left end 1 mm below the text.
BOX_PT = {
    "box_x_pt": """CASE box WHEN 'rect' THEN x_pt - font_size * 0.5D WHEN 'circle' THEN x_pt + font_size * 0.48D
        WHEN 'underline' THEN x_pt END""",
    "box_y_pt": """CASE box WHEN 'rect' THEN y_pt - font_size * 0.5D WHEN 'circle' THEN y_pt + font_size * 0.38D
        WHEN 'underline' THEN y_pt - 72D / 25.4D END""",
    "box_w_pt": "CASE WHEN box IN ('rect', 'underline') THEN w_pt END",
    "box_h_pt": "CASE box WHEN 'rect' THEN font_size * 2D END",
    "box_r_pt": "CASE box WHEN 'circle' THEN font_size * 0.75D END",
}
