"""Named queries: each operator over the given tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventdocs.operators import badges, citations, contents, numbering, pages, receipts
from eventdocs.operators.constants import constants_rejects, with_constants
from eventdocs.operators.ordinal import dense_ordinal, doubled_keys, running_total, tied_ordinal, use_checkpoints
from eventdocs.plans import fixtures
from eventdocs.schemas import ROSTER_COLUMNS
from eventdocs.sinks import tables
from eventdocs.sources import contents as contents_source
from eventdocs.sources import feed as feed_source
from eventdocs.sources import roster as roster_source

Query = Callable[[SparkSession, str], DataFrame]

# Items of the given web pages: their one headline and the links of their menu.
WEB_PAGE_ITEMS = contents.ItemRule(heading="h1", wrapper="nav", item="li", title="a")

#: Rows of roster files, of 40 rows each, that one task writes.
ROSTER_PART_ROWS = 10_000


def badge_layout(spark: SparkSession, folder: str) -> DataFrame:
    return badges.badge_layout(fixtures.roster(spark, folder))


def badge_sheets(spark: SparkSession, folder: str) -> DataFrame:
    return badges.badge_sheets(fixtures.roster(spark, folder), fixtures.badge_events(spark, folder))


def badge_blank(spark: SparkSession, folder: str) -> DataFrame:
    return badges.badge_blank(fixtures.hosts(spark, folder))


def badge_elements(spark: SparkSession, folder: str) -> DataFrame:
    layout = badges.badge_layout(fixtures.roster(spark, folder))
    return badges.badge_elements(layout, fixtures.badge_events(spark, folder))


def badge_blank_elements(spark: SparkSession, folder: str) -> DataFrame:
    events = fixtures.hosts(spark, folder)
    return badges.badge_elements(badges.badge_blank(events), events)


def receipt_items(spark: SparkSession, folder: str) -> DataFrame:
    items = receipts.receipt_items(fixtures.roster(spark, folder))
    return receipts.with_proviso(items, fixtures.receipt_events(spark, folder))


def receipt_pages(spark: SparkSession, folder: str) -> DataFrame:
    return receipts.receipt_pages(fixtures.roster(spark, folder))


def receipt_footers(spark: SparkSession, folder: str) -> DataFrame:
    return receipts.receipt_footers(fixtures.roster(spark, folder), fixtures.receipt_events(spark, folder))


def receipt_blank(spark: SparkSession, folder: str) -> DataFrame:
    return receipts.receipt_blank(fixtures.hosts(spark, folder))


def receipt_blank_footers(spark: SparkSession, folder: str) -> DataFrame:
    return receipts.receipt_blank_footers(fixtures.hosts(spark, folder))


def receipt_blank_elements(spark: SparkSession, folder: str) -> DataFrame:
    events = fixtures.hosts(spark, folder)
    return receipts.receipt_elements(receipts.receipt_blank(events), events, stamped=False)


def receipt_elements(spark: SparkSession, folder: str) -> DataFrame:
    items = receipts.receipt_items(fixtures.roster(spark, folder))
    return receipts.receipt_elements(items, fixtures.receipt_events(spark, folder))


def session_labels(spark: SparkSession, folder: str) -> DataFrame:
    return numbering.session_labels(fixtures.sessions(spark, folder), "session_id")


def page_labels(spark: SparkSession, folder: str) -> DataFrame:
    return numbering.page_labels(fixtures.manuscripts(spark, folder), "doc_id")


def page_requests(spark: SparkSession, folder: str) -> DataFrame:
    return numbering.page_requests(fixtures.requested_pages(spark, folder), "request_id")


def page_overlay(spark: SparkSession, folder: str) -> DataFrame:
    numbers = numbering.page_labels(fixtures.overlay_requests(spark, folder), "manuscript")
    return pages.page_overlay(fixtures.base_pages(spark, folder), numbers, "manuscript")


def _doubled_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Page numbers of which every fourth comes once more."""
    numbers = numbering.page_labels(fixtures.overlay_requests(spark, folder), "manuscript")
    again = numbers.where("page_no % 4 = 0").withColumn("label", F.concat("label", F.lit("b")))
    return numbers.unionByName(again)


def page_overlay_doubled(spark: SparkSession, folder: str) -> DataFrame:
    """An overlay with doubled pages changes no base page and doubles none."""
    return pages.page_overlay(fixtures.base_pages(spark, folder), _doubled_overlay(spark, folder), "manuscript")


def page_overlay_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Overlay pages that are doubled or have no base page."""
    return pages.page_overlay_rejects(fixtures.base_pages(spark, folder), _doubled_overlay(spark, folder), "manuscript")


def page_combine(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_combine(fixtures.file_pages(spark, folder), fixtures.page_files(spark, folder))


def page_combine_listed(spark: SparkSession, folder: str) -> DataFrame:
    listed, files = fixtures.file_pages(spark, folder), fixtures.page_files(spark, folder)
    return pages.page_combine(listed, files, order=pages.BY_LIST)


def page_combine_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_combine_rejects(fixtures.page_files(spark, folder), fixtures.file_pages(spark, folder))


def page_combine_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Files at all places where a list names them."""
    listed, held = fixtures.page_lists(spark, folder), fixtures.named_pages(spark, folder)
    return pages.page_combine(held, listed, order=pages.BY_LIST, by=pages.BY_FILE)


def page_combine_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are listed without pages, or have pages without being listed."""
    listed, held = fixtures.page_lists(spark, folder), fixtures.named_pages(spark, folder)
    return pages.page_combine_rejects(listed, held, by=pages.BY_FILE)


def citation_ja(spark: SparkSession, folder: str) -> DataFrame:
    return citations.with_citation_ja(fixtures.articles(spark, folder)).select("doc_id", "citation")


def citation_en(spark: SparkSession, folder: str) -> DataFrame:
    return citations.with_citation_en(fixtures.articles(spark, folder)).select("doc_id", "citation")


def citation_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return citations.citation_rejects(fixtures.articles(spark, folder), "ja").select("doc_id", "volume", "doi")


def citation_rejects_en(spark: SparkSession, folder: str) -> DataFrame:
    return citations.citation_rejects(fixtures.articles(spark, folder), "en").select("doc_id", "volume", "doi")


def _read_feeds(spark: SparkSession, folder: str) -> DataFrame:
    return citations.feed_entries(citations.parse_feeds(fixtures.feeds(spark, folder)), ["feed_id"])


def feed_citations_ja(spark: SparkSession, folder: str) -> DataFrame:
    """From XML to citations; an empty element is a missing part."""
    return citations.with_citation_ja(_read_feeds(spark, folder)).select("feed_id", "ordinal", "citation")


def feed_citations_en(spark: SparkSession, folder: str) -> DataFrame:
    return citations.with_citation_en(_read_feeds(spark, folder)).select("feed_id", "ordinal", "citation")


def feed_citation_rejects(spark: SparkSession, folder: str) -> DataFrame:
    entries = _read_feeds(spark, folder)
    rejects = [citations.citation_rejects(entries, lang).withColumn("lang", F.lit(lang)) for lang in ("ja", "en")]
    return rejects[0].unionByName(rejects[1]).select("feed_id", "ordinal", "lang", "doi")


def _html_list(spark: SparkSession, folder: str, lang: str) -> DataFrame:
    return citations.citation_html(fixtures.articles(spark, folder, numbered=True), ["lang", "doc_id"], lang)


def citation_html_ja(spark: SparkSession, folder: str) -> DataFrame:
    return _html_list(spark, folder, "ja")


def citation_html_en(spark: SparkSession, folder: str) -> DataFrame:
    return _html_list(spark, folder, "en")


def feed_entries(spark: SparkSession, folder: str) -> DataFrame:
    entries = citations.feed_entries(citations.parse_feeds(fixtures.feeds(spark, folder)), ["feed_id"])

    def text(name: str):
        return F.when(F.col(name) != "", F.col(name))

    return entries.select(
        "feed_id",
        "ordinal",
        text("article_title.en").alias("title_en"),
        text("article_title.ja").alias("title_ja"),
        F.col("article_link.ja").alias("link_ja"),
        F.array_join("author.en.name", "; ").alias("authors_en"),
        F.array_join("author.ja.name", "; ").alias("authors_ja"),
        text("volume").alias("volume"),
        "number",
        "startingPage",
        "endingPage",
        "pubyear",
        "doi",
    )


def html_items(spark: SparkSession, folder: str) -> DataFrame:
    web = fixtures.given(spark, folder, "pages")["pages"]
    return contents.contents_rows(contents.html_items(web, ["page_id"], WEB_PAGE_ITEMS), ["page_id"])


def contents_items(spark: SparkSession, folder: str) -> DataFrame:
    listed = fixtures.contents_pages(spark, folder)
    return contents.contents_rows(contents.html_items(listed, ["page_id"]), ["page_id"])


def _new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared checkpoint folder, for tables that are written and read back."""
    return f"{use_checkpoints(spark)}/eventdocs-{uuid4().hex}"


def _roster_files(spark: SparkSession, folder: str, by: str = "event_id") -> str:
    """Rosters as CSV files by event, several to an event, with other headers where ``by`` is odd than where it is even."""
    path, cells = _new_folder(spark), fixtures.roster_cells(spark, folder)
    # In as many ranges as keep a task's files few: past 999 files of an event their names are no longer in their order.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells.count() // ROSTER_PART_ROWS))
    headers = {0: ("参加費", "懇親会参加費", "研修会参加費"), 1: ("fee", "dinner", "trip")}
    for odd, names in headers.items():
        own = cells.where(F.col(by) % 2 == odd).repartitionByRange(parts, "event_id", "entry_no")
        own = own.sortWithinPartitions("event_id", "entry_no")
        own = own.select("event_id", *ROSTER_COLUMNS).withColumnsRenamed(dict(zip(ROSTER_COLUMNS[3:6], names)))
        writer = own.write.partitionBy("event_id").mode("append").option("maxRecordsPerFile", 40)
        spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.csv(path, header=True, escape='"', quoteAll=True, **spaces)
    return path


def roster_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of rows of which a third share one entry number; a slice of more than 1,024 rows is cut."""
    return tied_ordinal(fixtures.sign_ups(spark, folder), ["event_id"], "entry_no", "position", tie="place", most=1024)


def roster_doubles(spark: SparkSession, folder: str) -> DataFrame:
    """Entry numbers that occur more than once."""
    return doubled_keys(fixtures.sign_ups(spark, folder), ["event_id"], "entry_no")


def event_constants_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Events that have their constants more than once."""
    hosts = fixtures.hosts(spark, folder)
    return constants_rejects(hosts.unionByName(hosts.where("event_id % 3 = 0")))


def _damaged_folder(spark: SparkSession, folder: str) -> str:
    path, lines = _new_folder(spark), fixtures.damaged_lines(spark, folder)
    # By a hash of its own: a union of parts that are both dealt out by event counts as dealt out, though its parts differ.
    placed = lines.repartition(F.xxhash64("event_id")).sortWithinPartitions("event_id", "entry_no")
    placed.select("event_id", "line").write.partitionBy("event_id").text(path)
    return path


def roster_damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Attendees of files with damaged lines: only those lines are lost."""
    rows = roster_source.read_roster_csv(spark, _damaged_folder(spark, folder))
    return dense_ordinal(rows, ["event_id"], "entry_no", "position").drop("entry_no")


def roster_damaged_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The damaged lines, as they are written."""
    rejects = roster_source.read_roster_rejects(spark, _damaged_folder(spark, folder))
    return rejects.select("event_id", "column", "text", "reason")


def _roster_tables(spark: SparkSession, folder: str) -> str:
    """Rosters as Parquet files by event, and in every fifth event's folder a file that is no table."""
    path, rows = _new_folder(spark), fixtures.roster(spark, folder)
    total = F.col("fee_attend") + F.coalesce("fee_dinner", F.lit(0)) + F.col("fee_workshop")
    rows.withColumn("total", total).repartition("event_id").write.partitionBy("event_id").parquet(path)
    garbage = rows.where("event_id % 5 = 0").select("event_id").distinct().withColumn("value", F.lit("no table"))
    garbage.repartition("event_id").write.partitionBy("event_id").mode("append").text(path)
    return path


def roster_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """Roster tables beside files that cannot be read."""
    return roster_source.read_roster_parquet(spark, _roster_tables(spark, folder))


def roster_parquet_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The files that cannot be read."""
    return roster_source.read_roster_parquet_rejects(spark, _roster_tables(spark, folder)).drop("file")


def roster_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Roster files read by column position, with each row's position in its event."""
    rows = roster_source.read_roster_csv(spark, _roster_files(spark, folder))
    return dense_ordinal(rows, ["event_id"], "entry_no", "position").drop("entry_no")


def roster_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of roster files that should hold an amount and do not."""
    return roster_source.read_roster_rejects(spark, _roster_files(spark, folder)).drop("entry_no")


def roster_fee_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts named by the headers of the event's own roster files."""
    path = _roster_files(spark, folder)
    labelled = with_constants(
        roster_source.read_roster_csv(spark, path), roster_source.read_fee_labels(spark, path)
    )
    return receipts.receipt_items(labelled).select("event_id", "slot_no", "recipient", "amount_text", "fee_label")


def roster_fee_label_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose files disagree on the fees' headers, and how many versions they have."""
    rejects = roster_source.read_fee_label_rejects(spark, _roster_files(spark, folder, by="entry_no"))
    return rejects.select("event_id", F.size("fee_labels").cast("bigint").alias("versions"))


def _feed_folder(spark: SparkSession, folder: str) -> str:
    path = _new_folder(spark)
    fixtures.feed_files(spark, folder).write.partitionBy("feed_id").text(path)
    return path


def feed_file_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of feeds in files, in their feed's order and up to its count."""
    entries = feed_source.read_feed_entries(spark, _feed_folder(spark, folder), ["feed_id"])
    return entries.select(F.col("feed_id").cast("bigint").alias("feed_id"), "ordinal", "number", "doi")


def feed_file_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Feed files that are not read in full."""
    rejects = feed_source.read_feed_rejects(spark, _feed_folder(spark, folder), ["feed_id"])
    return rejects.select(F.col("feed_id").cast("bigint").alias("feed_id"), "reason", "entries")


def feed_broken_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds whose entries, read one by one without their number, stop being XML."""
    entries = feed_source.read_entries(spark, _feed_folder(spark, folder))
    number = F.regexp_extract("feed_file", "feed_id=([0-9]+)", 1).cast("bigint")
    return feed_source.broken_entries(entries).select(number.alias("feed_id"))


def badge_files(spark: SparkSession, folder: str) -> DataFrame:
    """The badge layout written by event and read back."""
    path, layout = _new_folder(spark), badge_layout(spark, folder)
    tables.write_by_event(layout, path, tables.BADGE_ORDER)
    return spark.read.schema(layout.schema).parquet(path)


def receipt_files(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts written by event and read back."""
    path, items = _new_folder(spark), receipts.receipt_items(fixtures.roster(spark, folder))
    tables.write_by_event(items, path, tables.RECEIPT_ORDER)
    return spark.read.schema(items.schema).parquet(path)


def badge_files_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Badges of all events, written with wrong names, then again for every second event and again for the others: each
    write replaces its own events only, and writing twice leaves one copy."""
    path, layout = _new_folder(spark), badge_layout(spark, folder)
    tables.write_by_event(layout.withColumn("name", F.lit("wrong")), path, tables.BADGE_ORDER)
    for odd in (0, 1, 1):
        tables.write_by_event(layout.where(F.col("event_id") % 2 == odd), path, tables.BADGE_ORDER)
    return spark.read.schema(layout.schema).parquet(path)


def receipt_files_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts of all events, then those of every third event once more, in another version."""
    path, items = _new_folder(spark), receipts.receipt_items(fixtures.roster(spark, folder))
    tables.write_by_event(items, path, tables.RECEIPT_ORDER)
    again = items.where("event_id % 3 = 0").withColumn("recipient", F.concat("recipient", F.lit(" *")))
    tables.write_by_event(again, path, tables.RECEIPT_ORDER)
    return spark.read.schema(items.schema).parquet(path)


#: Part files of the lists that the queries write, so that lists of the small tables have several.
_PART_BYTES = 1 << 18


def _list_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of lists as written, numbered through each list's files in the order of their names.

    Files are read split by split. A line's place in its split is told by ids that rise by one in a task; the splits' counts
    are summed up on a narrow row each."""
    split = {"file": F.col("_metadata.file_name"), "split": F.col("_metadata.file_block_start")}
    read = spark.read.text(path, lineSep="\n").select("lang", "value", *[c.alias(n) for n, c in split.items()])
    lines = read.withColumn("at", F.monotonically_increasing_id())
    sizes = lines.groupBy("lang", *split).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    sizes = running_total(sizes, ["lang"], list(split), "n", "before").select("lang", *split, "before", "first")
    rows = lines.join(F.broadcast(sizes), ["lang", *split])
    return rows.select("lang", (F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "value")


def citation_list_files(spark: SparkSession, folder: str) -> DataFrame:
    """The English list as written."""
    path = _new_folder(spark)
    tables.write_html_list(citation_html_en(spark, folder), path, "lang", part_bytes=_PART_BYTES)
    return _list_lines(spark, path)


def citation_list_files_ja(spark: SparkSession, folder: str) -> DataFrame:
    """The Japanese list as written."""
    path = _new_folder(spark)
    tables.write_html_list(citation_html_ja(spark, folder), path, "lang", part_bytes=_PART_BYTES)
    return _list_lines(spark, path)


def citation_list_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """The English list, then the lists of two languages once more and shorter: no old part is left of them."""
    path, items = _new_folder(spark), citation_html_en(spark, folder)
    tables.write_html_list(items, path, "lang", part_bytes=1 << 14)
    again = items.where("lang IN ('en', 'es') AND item_index % 5 = 0")
    tables.write_html_list(again, path, "lang", part_bytes=_PART_BYTES)
    return _list_lines(spark, path)


def contents_page_files(spark: SparkSession, folder: str) -> DataFrame:
    """Contents pages read from HTML files."""
    path, listed = _new_folder(spark), fixtures.contents_pages(spark, folder)
    listed.select("html", "page_id").repartition("page_id").write.partitionBy("page_id").text(path)
    read = contents_source.read_contents_pages(spark, path)
    number = F.regexp_extract("url", "page_id=([0-9]+)", 1).cast("bigint")
    items = contents.html_items(read.withColumn("page_id", number), ["page_id"])
    return contents.contents_rows(items, ["page_id"])


def contents_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the contents pages written as CSV and read back."""
    path, rows = _new_folder(spark), contents_items(spark, folder).drop("kind")
    tables.write_contents_rows(rows, path, "page_id")
    return spark.read.schema(rows.schema).options(multiLine="true", **tables.CONTENTS_CSV).csv(path)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        badge_layout,
        badge_sheets,
        badge_blank,
        badge_elements,
        badge_blank_elements,
        receipt_items,
        receipt_pages,
        receipt_footers,
        receipt_blank,
        receipt_blank_elements,
        receipt_blank_footers,
        receipt_elements,
        session_labels,
        page_labels,
        page_requests,
        page_overlay,
        page_overlay_doubled,
        page_overlay_rejects,
        page_combine,
        page_combine_listed,
        page_combine_rejects,
        page_combine_twice,
        page_combine_unmatched,
        citation_ja,
        citation_en,
        citation_rejects,
        citation_rejects_en,
        feed_citations_ja,
        feed_citations_en,
        feed_citation_rejects,
        citation_html_ja,
        citation_html_en,
        feed_entries,
        html_items,
        contents_items,
        contents_page_files,
        roster_ties,
        roster_doubles,
        event_constants_rejects,
        roster_csv,
        roster_rejects,
        roster_damaged,
        roster_damaged_rejects,
        roster_parquet,
        roster_parquet_rejects,
        roster_fee_labels,
        roster_fee_label_rejects,
        feed_file_entries,
        feed_file_rejects,
        feed_broken_entries,
        badge_files,
        receipt_files,
        badge_files_replaced,
        receipt_files_replaced,
        citation_list_files,
        citation_list_files_ja,
        citation_list_replaced,
        contents_files,
    )
}
