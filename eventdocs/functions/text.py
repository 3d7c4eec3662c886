"""Text expressions of the documents, all built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventdocs import layout


def amount_text(amount: Column) -> Column:
    """Yen amount with thousands separators between full-width signs."""
    return F.concat(F.lit(layout.AMOUNT_PREFIX), F.format_number(amount, 0), F.lit(layout.AMOUNT_SUFFIX))


def recipient_text(name: Column) -> Column:
    return F.concat(name, F.lit(layout.RECIPIENT_SUFFIX))


def proviso_text(congress: Column, fee_label: Column) -> Column:
    return F.concat(F.lit(layout.PROVISO_PREFIX), congress, fee_label, F.lit(layout.PROVISO_SUFFIX))


def present(value: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(value != "", F.lit(False))


def fit_font_size(text: Column) -> Column:
    """Font size that keeps a text inside the badge; null where there is no text."""
    fitted = F.least(F.lit(layout.AFFILIATION_FIT_WIDTH) / F.length(text), F.lit(layout.AFFILIATION_MAX_SIZE))
    return F.when(present(text), fitted)


def is_marked(fee: Column) -> Column:
    """A participation mark needs a fee above zero; a missing fee is no participation."""
    return F.coalesce(fee > 0, F.lit(False))


def session_label(pre: Column, number: Column, post: Column) -> Column:
    """Number padded to at least two digits. (lpad would cut 100 down to 10.)"""
    return F.concat(pre, F.format_string("%02d", number), post)


def page_label(pre: Column, number: Column, post: Column) -> Column:
    return F.concat(pre, number.cast("string"), post)


def clean_feed_text(text: Column) -> Column:
    """Drop every pair of spaces, then every newline. Runs of spaces are not collapsed to one."""
    return F.replace(F.replace(text, F.lit("  "), F.lit("")), F.lit("\n"), F.lit(""))


def clean_contents_text(text: Column) -> Column:
    """Drop line breaks and tabs; a space followed by a literal plus sign becomes a space."""
    return F.replace(F.translate(text, "\n\r\t", ""), F.lit(" +"), F.lit(" "))


def section_text(text: Column) -> Column:
    """Only short item texts are section headings."""
    return F.when(F.length(text) > 20, "").otherwise(text)


def text_lines(text: Column) -> Column:
    """Lines of a text; a trailing newline gives a last empty line."""
    return F.split(text, "\n", -1)


def author_list(names: Column) -> Column:
    """Cleaned names joined by commas, null where there are none."""
    joined = F.array_join(F.transform(names, clean_feed_text), ", ")
    return F.when(F.size(names) > 0, joined)
