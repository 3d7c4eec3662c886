"""From an element list to one row per drawn element."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from eventdocs.functions.geometry import BOX_PT, TEXT_BOX, TEXT_X_PT
from eventdocs.layout import FONT_NAME, Element

_FIELDS = {
    "element": ("name", "STRING"),
    "kind": ("kind", "STRING"),
    "dx": ("dx", "DOUBLE"),
    "dy": ("dy", "DOUBLE"),
    "width_mm": ("width", "DOUBLE"),
    "height_mm": ("height", "DOUBLE"),
    "line_width_mm": ("line_width", "DOUBLE"),
    "font_size": ("font_size", "DOUBLE"),
    "color": ("color", "STRING"),
    "bg_color": ("bg_color", "STRING"),
    "shape": ("shape", "STRING"),
    "align": ("align", "STRING"),
}


def _literal(value, dtype: str) -> str:
    if value is None:
        return "NULL"
    return f"'{value}'" if dtype == "STRING" else f"{float(value)}D"


def expand_elements(
    rows: DataFrame,
    keep: Sequence[str],
    elements: Sequence[Element],
    texts: Mapping[str, str],
    overrides: Mapping[tuple[str, str], str],
    conditions: Mapping[str, str],
) -> DataFrame:
    """One row per (row, element) whose condition holds, placed from the row's ``x_mm`` and ``y_mm`` corner.

    ``texts``, ``overrides`` and ``conditions`` are SQL over the row's columns, by element or (element, field). The
    list's own values are literals picked by element number. So this is a generate step, a filter and projections,
    without join or shuffle.
    """
    number_of = {element.name: number for number, element in enumerate(elements, start=1)}

    def choose(choices: Mapping[str, str], otherwise: str) -> str:
        cases = " ".join(f"WHEN {number_of[name]} THEN {sql}" for name, sql in choices.items())
        return f"CASE element_no {cases} ELSE {otherwise} END" if choices else otherwise

    def field(name: str, dtype: str) -> str:
        values = [_literal(getattr(element, name), dtype) for element in elements]
        listed = f"CAST(array({', '.join(values)}) AS ARRAY<{dtype}>)"
        own = {element: sql for (element, of), sql in overrides.items() if of == name}
        return choose(own, f"element_at({listed}, CAST(element_no AS INT))")

    numbered = rows.selectExpr("*", f"explode(sequence(1L, {len(elements)}L)) AS element_no")
    drawn = numbered.where(choose(conditions, "true"))
    fields = drawn.selectExpr(
        *keep,
        "element_no",
        f"{choose(texts, 'NULL')} AS text",
        "x_mm AS corner_x",
        "y_mm AS corner_y",
        *[f"{field(name, dtype)} AS {column}" for column, (name, dtype) in _FIELDS.items()],
    )
    placed = fields.selectExpr("* EXCEPT (corner_x, corner_y)", "corner_x + dx AS x_mm", "corner_y + dy AS y_mm")
    in_points = placed.selectExpr(
        "*",
        "x_mm * 72D / 25.4D AS x_pt",
        "y_mm * 72D / 25.4D AS y_pt",
        "width_mm * 72D / 25.4D AS w_pt",
        f"{TEXT_BOX} AS box",
    )
    return in_points.selectExpr(
        *keep,
        *"element_no element kind text x_mm y_mm width_mm height_mm line_width_mm".split(),
        f"CASE kind WHEN 'text' THEN '{FONT_NAME}' END AS font_name",
        *"font_size color bg_color align".split(),
        f"CASE kind WHEN 'text' THEN {TEXT_X_PT} END AS text_x_pt",
        "CASE kind WHEN 'text' THEN y_pt END AS text_y_pt",
        "box",
        *[f"{sql} AS {column}" for column, sql in BOX_PT.items()],
    )
