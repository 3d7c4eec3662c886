"""Bibliographic citations and HTML list items from article feeds, in Japanese and English."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventdocs.functions.text import author_list, clean_feed_text, present
from eventdocs.schemas import FEED
from eventdocs.sources.feed import XML_OPTIONS

# Journal names of the citations.
JOURNAL_JA, JOURNAL_EN = "植生学会誌", "Vegetation Science"
# Fixed value: a feed has nine header elements before its entries.
FEED_HEADERS = 9

_REQUIRED = ("volume", "number", "startingPage", "endingPage", "pubyear")


def _complete(lang: str) -> Column:
    """Whether every part of a citation is there; an empty element is a missing part."""
    complete = present(F.col(f"article_link.{lang}"))
    for name in _REQUIRED:
        complete = complete & present(F.col(name))
    return complete


def _titled(entries: DataFrame, lang: str) -> DataFrame:
    return entries.where(present(F.col(f"article_title.{lang}")))


def citation_rejects(entries: DataFrame, lang: str) -> DataFrame:
    """Titled entries that lack a part of the citation."""
    return _titled(entries, lang).where(~_complete(lang))


def with_citation_ja(entries: DataFrame, journal: str = JOURNAL_JA) -> DataFrame:
    """Entries with a Japanese title, and their citation; authors are left out where there are none."""
    c = F.col
    citation = F.concat_ws(
        ", ",
        author_list(c("author.ja.name")),
        F.concat(clean_feed_text(c("article_title.ja")), F.lit(". "), F.lit(journal)),
        c("pubyear"),
        F.concat(c("volume"), F.lit("巻")),
        F.concat(c("number"), F.lit("号")),
        F.concat(F.lit("p."), c("startingPage"), F.lit("-"), c("endingPage")),
    )
    return _titled(entries, "ja").where(_complete("ja")).withColumn("citation", citation)


def with_citation_en(entries: DataFrame, journal: str = JOURNAL_EN) -> DataFrame:
    """Entries with an English title, and their citation; it starts with ", " where there are no authors."""
    c = F.col
    citation = F.concat_ws(
        ", ",
        F.coalesce(author_list(c("author.en.name")), F.lit("")),
        F.concat(clean_feed_text(c("article_title.en")), F.lit(" "), F.lit(journal)),
        c("pubyear"),
        F.concat(F.lit("Volume"), c("volume")),
        F.concat(F.lit("Issue "), c("number")),
        F.concat(F.lit("Pages"), c("startingPage"), F.lit("-"), c("endingPage")),
    )
    return _titled(entries, "en").where(_complete("en")).withColumn("citation", citation)


def _list_item(index: Column, link: Column, citation: Column) -> Column:
    # The lines of a list item. Texts go in as they are, without HTML escaping.
    return F.concat_ws(
        "\n",
        index.cast("string"),
        F.lit('<li style="margin-left: 40px; padding-bottom: 15px;">'),
        F.concat(F.lit(' <a href="'), link, F.lit('">')),
        F.concat(F.lit("     "), citation),
        F.lit(" </a>"),
        F.lit("</li>"),
    )


def citation_html(entries: DataFrame, keep: Sequence[str], lang: str, ordinal: str = "ordinal") -> DataFrame:
    """List items. ``ordinal`` counts all entries of a feed from 0, titled or not.

    Japanese lists show it as it is, English ones count the feed's header elements too.
    """
    cited = with_citation_ja(entries) if lang == "ja" else with_citation_en(entries)
    index = F.col(ordinal) if lang == "ja" else F.col(ordinal) + FEED_HEADERS
    item = _list_item(index, F.col(f"article_link.{lang}"), F.col("citation"))
    return cited.select(*keep, index.alias("item_index"), item.alias("value"))


def parse_feeds(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Feed documents held in a column: ``totalResults`` and ``entry`` instead of the text.

    Whitespace is kept as it is, and all parts of an entry are texts: page 001 stays 001.
    """
    others = [c for c in feeds.columns if c != xml]
    return feeds.select(*others, F.from_xml(xml, FEED, XML_OPTIONS).alias("feed")).select(*others, "feed.*")


def feed_rejects(feeds: DataFrame) -> DataFrame:
    """Parsed feeds without a readable count of results or without entries."""
    return feeds.where(F.col("totalResults").isNull() | F.col("entry").isNull() | (F.size("entry") == 0))


def feed_entries(feeds: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per entry with its ``ordinal`` in the feed, up to the feed's own count of results."""
    return (
        feeds.select(*keep, "totalResults", F.posexplode("entry").alias("pos", "e"))
        .where(F.col("pos") < F.col("totalResults"))
        .select(*keep, F.col("pos").cast("bigint").alias("ordinal"), "e.*")
    )
