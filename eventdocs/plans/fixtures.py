"""Input tables of the queries, derived from the given tables.

Texts named ``*_SQL`` run on Spark and on DuckDB alike; ``{table}`` stands for a given table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventdocs.functions.text import text_lines
from eventdocs.operators.ordinal import dense_ordinal

# Attendees of 25 events, with empty and missing affiliations and zero and missing fees.
ROSTER_SQL = """
SELECT CAST(c_nationkey AS BIGINT) AS event_id, c_custkey AS entry_no, c_name AS name,
  CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN NULL
       ELSE n_name || repeat('x', CAST(c_custkey % 20 AS INT)) END AS affiliation,
  c_mktsegment AS member_type,
  CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 2000 ELSE 4000 END AS BIGINT) AS fee_attend,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 17 = 0 THEN NULL ELSE 6000 END AS BIGINT) AS fee_dinner,
  CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 12500 END AS BIGINT) AS fee_workshop
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

# The same attendees as cells of roster files: fees with a point or separators, one that is no number, line breaks.
ROSTER_CELLS_SQL = """
SELECT event_id, entry_no, name,
  CASE WHEN entry_no % 37 = 0 THEN affiliation || chr(10) || '"2", x' ELSE affiliation END AS affiliation, member_type,
  CASE WHEN entry_no % 31 = 0 THEN '免除' WHEN entry_no % 10 = 1 THEN CAST(fee_attend AS STRING) || '.0'
       WHEN entry_no % 10 = 2 AND fee_attend > 0
         THEN substr(CAST(fee_attend AS STRING), 1, 1) || ',' || substr(CAST(fee_attend AS STRING), 2)
       ELSE CAST(fee_attend AS STRING) END AS fee_attend,
  CAST(fee_dinner AS STRING) AS fee_dinner, CAST(fee_workshop AS STRING) AS fee_workshop,
  CAST(fee_attend + coalesce(fee_dinner, 0) + fee_workshop AS STRING) AS total
FROM {roster}
"""

BADGE_EVENTS_SQL = """
SELECT CAST(n_nationkey AS BIGINT) AS event_id, n_name || '大会' AS congress, '2025年10月10日' AS event_date,
  n_name || '実行委員会' AS committee, '大会委員会' AS committee_sub, n_name || '会館' AS place,
  '所属' AS label_affiliation, '氏名' AS label_name,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE '#00a960' END AS strip_color
FROM {nation}
"""

# Footer texts of up to 13 lines, so some are cut; each ends in a newline, so the last line is empty.
RECEIPT_EVENTS_SQL = """
SELECT CAST(n_nationkey AS BIGINT) AS event_id, '領収書' AS title, n_name || '大会' AS congress,
  '大会委員会' AS committee_sub, '会長 ' || n_name AS president, '2025年10月10日' AS receipt_date,
  '領収書について' || chr(10) || repeat('備考' || chr(10), CAST(n_nationkey % 12 AS INT)) AS footer_text_1,
  '事務局' || chr(10) || n_name || chr(10) AS footer_text_2,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(501 AS BIGINT) END AS image_width,
  CAST(400 + n_nationkey AS BIGINT) AS image_height
FROM {nation}
"""

# Hosts of small events that need blank forms only.
HOSTS_SQL = """
SELECT s_suppkey AS event_id, s_name || '研究会' AS congress, s_suppkey % 4 AS n_sheet,
  CASE s_suppkey % 4 WHEN 0 THEN '参加費' WHEN 1 THEN '参加費,現地研修会参加費' WHEN 2 THEN '懇親会参加費'
       ELSE '' END AS items_text,
  '2025年10月10日' AS event_date, s_name || '実行委員会' AS committee, '大会委員会' AS committee_sub, '会館' AS place,
  '所属' AS label_affiliation, '氏名' AS label_name, 'navy' AS strip_color, '領収書' AS title,
  '会長 ' || s_name AS president, '2025年10月10日' AS receipt_date,
  '領収書について' || chr(10) || repeat('備考' || chr(10), CAST(s_suppkey % 10 AS INT)) AS footer_text_1,
  '事務局' AS footer_text_2, CAST(501 AS BIGINT) AS image_width, CAST(493 AS BIGINT) AS image_height
FROM {supplier}
"""

# One session per event and segment; numbering starts at 85 to 99, so it passes 100; some sessions are empty, and some
# lack a bound.
SESSIONS_SQL = """
SELECT n_name || '/' || c_mktsegment AS session_id, c_mktsegment AS pre,
  CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE '' END AS post,
  CAST(CASE WHEN n_nationkey % 11 <> 5 THEN 85 + n_nationkey % 15 END AS BIGINT) AS start,
  CAST(CASE WHEN n_nationkey % 13 <> 4 THEN 84 + n_nationkey % 15 + CASE WHEN n_nationkey % 7 = 6 THEN -count(*) ELSE count(*) END END AS BIGINT) AS "end",
  CAST(CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 0 END AS DOUBLE) AS bleed_mm
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
GROUP BY n_name, n_nationkey, c_mktsegment
"""

# Manuscripts of a page per 1,000 characters; some state no first or no last page.
MANUSCRIPTS_SQL = """
SELECT doc_id, CAST(CASE WHEN doc_id % 5 <> 0 THEN 1 END AS BIGINT) AS start,
  CASE WHEN doc_id % 7 <> 0 THEN 1 + n_chars // 1000 END AS "end",
  CAST(CASE WHEN doc_id % 3 = 0 THEN 15 END AS DOUBLE) AS x_mm,
  CAST(doc_id % 4 AS DOUBLE) AS bleed_mm, CAST(12 AS DOUBLE) AS font_size
FROM {documents}
"""

PAGE_REQUESTS_SQL = """
SELECT p_partkey AS request_id, CASE WHEN p_partkey % 3 = 2 THEN 'blank' ELSE 'division' END AS kind, p_name AS text,
  CAST(CASE p_size % 3 WHEN 0 THEN 210 WHEN 1 THEN 297 ELSE 148 END AS DOUBLE) AS page_w_mm,
  CAST(CASE p_size % 3 WHEN 0 THEN 297 WHEN 1 THEN 420 ELSE 210 END AS DOUBLE) AS page_h_mm,
  CAST(p_partkey % 4 AS DOUBLE) AS bleed_mm,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN 10 + p_partkey % 50 END AS DOUBLE) AS x_mm,
  CAST(p_size AS DOUBLE) AS y_mm, CAST(20 + p_size % 30 AS DOUBLE) AS height_mm,
  CAST(8 + p_size AS DOUBLE) AS font_size,
  CASE WHEN p_partkey % 6 = 5 THEN 'greenyellow' END AS fill_color
FROM {part}
"""

# Files of pages, one combined document per language; listed by number, which is not the order of their names.
# One file cannot be read, one has no place in the list; the pages of two are numbered with a gap or twice.
FILES_SQL = """
SELECT DISTINCT lang AS job_id, source || '.pdf' AS file_name,
  CASE WHEN source <> 'src5' THEN CAST(substr(source, 4) AS BIGINT) END AS upload_seq,
  CASE WHEN source = 'src13' THEN 'broken' ELSE 'ok' END AS status
FROM {documents}
"""

# Lists that name some files twice, leave one out, and name one that has no pages.
LISTS_SQL = """
SELECT job_id, file_name, upload_seq, 'ok' AS status
FROM (SELECT DISTINCT lang AS job_id, source || '.pdf' AS file_name, CAST(substr(source, 4) AS BIGINT) AS upload_seq FROM {documents})
WHERE file_name <> 'src2.pdf'
UNION ALL
SELECT DISTINCT lang, source || '.pdf', 1000 + CAST(substr(source, 4) AS BIGINT), 'ok' FROM {documents}
WHERE source IN ('src1', 'src4')
UNION ALL
SELECT DISTINCT lang, 'ghost.pdf', CAST(7 AS BIGINT), 'ok' FROM {documents}
"""

# Sign-ups in which a third of an event's rows share one entry number; ``place`` tells them apart, though not all.
SIGN_UPS_SQL = """
SELECT l_suppkey % 7 AS event_id, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_orderkey END AS entry_no,
  l_orderkey * 8 + l_linenumber AS place, l_suppkey AS desk
FROM {lineitem}
"""

# Lines of roster files: some lack a cell, and the fourth of each event opens a quote and never closes it.
DAMAGED_LINES_SQL = """
SELECT event_id, entry_no, CASE WHEN row_number() OVER (PARTITION BY event_id ORDER BY entry_no) = 4 THEN '"' ELSE '' END
  || name || ',' || coalesce(affiliation, '') || ',' || member_type || ',' || CAST(fee_attend AS STRING) || ','
  || coalesce(CAST(fee_dinner AS STRING), '') || ',' || CAST(fee_workshop AS STRING)
  || CASE WHEN entry_no % 23 = 5 THEN '' ELSE ',' || CAST(fee_attend + coalesce(fee_dinner, 0) + fee_workshop AS STRING) END
  AS line
FROM {roster}
"""
ROSTER_HEADER = "氏名,所属,会員属性,参加費,懇親会参加費,研修会参加費,合計"


# Schemas of the given tables; a schema that is stated need not be read from the files first.
TABLES = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_suppkey BIGINT, l_linenumber INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
}


def given(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet") for name in names}


def _derived(spark: SparkSession, folder: str, sql: str, *tables: str) -> DataFrame:
    spark_sql = sql.replace(" // ", " div ").replace('"end"', "`end`")
    return spark.sql(spark_sql, **given(spark, folder, *tables))


def roster(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, ROSTER_SQL, "customer", "nation")


def roster_cells(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(ROSTER_CELLS_SQL, roster=roster(spark, folder))


def badge_events(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, BADGE_EVENTS_SQL, "nation")


def _with_footers(events: DataFrame) -> DataFrame:
    footers = {f"footer_{side}": text_lines(F.col(f"footer_text_{side}")) for side in (1, 2)}
    return events.withColumns(footers).drop("footer_text_1", "footer_text_2")


def receipt_events(spark: SparkSession, folder: str) -> DataFrame:
    return _with_footers(_derived(spark, folder, RECEIPT_EVENTS_SQL, "nation"))


def hosts(spark: SparkSession, folder: str) -> DataFrame:
    events = _with_footers(_derived(spark, folder, HOSTS_SQL, "supplier"))
    return events.withColumn("items", F.split("items_text", ","))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, SESSIONS_SQL, "customer", "nation")


def manuscripts(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, MANUSCRIPTS_SQL, "documents")


def requested_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, PAGE_REQUESTS_SQL, "part")


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, FILES_SQL, "documents")


def file_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is a page of its source's file, in the job of its language."""
    documents = given(spark, folder, "documents")["documents"].select(
        F.col("lang").alias("job_id"),
        F.concat("source", F.lit(".pdf")).alias("file_name"),
        F.when(F.col("source") != "src5", F.substring("source", 4, 20).cast("bigint")).alias("upload_seq"),
        "doc_id",
    )
    numbered = dense_ordinal(documents, ["job_id", "file_name"], "doc_id", "_ordinal")
    n = F.col("_ordinal") + 1
    gap, twice = F.when(n > 1, n + 1).otherwise(n), F.greatest(n - 1, F.lit(1).cast("bigint"))
    name = F.col("file_name")
    page = F.when(name == "src7.pdf", gap).when(name == "src11.pdf", twice).otherwise(n)
    return numbered.withColumn("page_no", page).drop("_ordinal")


def page_lists(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, LISTS_SQL, "documents")


def named_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is a page of its source's file, numbered without gaps."""
    documents = given(spark, folder, "documents")["documents"]
    documents = documents.select(F.col("lang").alias("job_id"), F.concat("source", F.lit(".pdf")).alias("file_name"), "doc_id")
    numbered = dense_ordinal(documents, ["job_id", "file_name"], "doc_id", "_ordinal")
    return numbered.withColumn("page_no", F.col("_ordinal") + 1).drop("_ordinal")


def sign_ups(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder, SIGN_UPS_SQL, "lineitem")


def damaged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, entry_no, line), a header with entry number null in each event."""
    rows = roster(spark, folder)
    lines = spark.sql(DAMAGED_LINES_SQL, roster=rows)
    header = rows.select("event_id").distinct().select("event_id", F.lit(None).cast("bigint").alias("entry_no"), F.lit(ROSTER_HEADER).alias("line"))
    return lines.unionByName(header)


def base_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a language are the pages of one manuscript; page sizes vary."""
    documents = given(spark, folder, "documents")["documents"].select(
        F.col("lang").alias("manuscript"),
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, 297.0).otherwise(210.0).alias("page_w_mm"),
        F.when(F.col("doc_id") % 3 == 0, 420.0).otherwise(297.0).alias("page_h_mm"),
    )
    numbered = dense_ordinal(documents, ["manuscript"], "doc_id", "_ordinal")
    return numbered.withColumn("page_no", F.col("_ordinal") + 1).drop("_ordinal")


def overlay_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Page numbers for half of each manuscript, or for five pages more than it has."""
    documents = given(spark, folder, "documents")["documents"]
    pages = documents.groupBy(F.col("lang").alias("manuscript")).agg(F.count(F.lit(1)).alias("pages"))
    last = F.when(F.col("manuscript") == "es", F.col("pages") + 5).otherwise(F.expr("pages div 2"))
    return pages.select("manuscript", F.lit(1).cast("bigint").alias("start"), last.alias("end"))


def articles(spark: SparkSession, folder: str, numbered: bool = False) -> DataFrame:
    """Feed entries: a document's text is its title, the suppliers of the order of its number are its authors.

    Some titles are missing or empty, some entries have no authors, some lack the volume. ``numbered`` adds their
    ``ordinal`` in the feed of their language. An article's authors are one value, as they are in a feed.
    """
    t = given(spark, folder, "documents", "orders", "lineitem", "supplier")
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey")
    written = (
        lines.join(t["documents"].select("doc_id"), F.col("l_orderkey") == F.col("doc_id"), "left_semi")
        .join(t["supplier"].select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "s_name"))).alias("au"))
    )
    published = (
        t["documents"]
        .join(t["orders"], F.col("doc_id") == F.col("o_orderkey"))
        .select("doc_id", "lang", "text", "o_orderkey", "o_custkey", "o_orderdate")
    )
    if numbered:  # on narrow columns; the texts only meet their number
        listed = t["documents"].select("doc_id", "lang")
        listed = listed.join(t["orders"].select("o_orderkey"), F.col("doc_id") == F.col("o_orderkey"), "left_semi")
        published = published.join(dense_ordinal(listed, ["lang"], "doc_id", "ordinal").drop("lang"), "doc_id")
    c = F.col
    doc = c("doc_id")
    spaced = F.concat(F.lit("  "), c("text"), F.lit("   .\n"))
    link = F.concat(F.lit("https://example.org/article/"), doc.cast("string"))

    def pair(en: Column, ja: Column) -> Column:
        return F.struct(en.alias("en"), ja.alias("ja"))

    def names(form) -> Column:
        return F.struct(F.transform("au", lambda a: form(a["s_name"])).alias("name"))

    return (
        published.join(written, doc == c("l_orderkey"), "left").select(
            "doc_id",
            "lang",
            *(["ordinal"] if numbered else []),
            pair(
                F.when(doc % 23 != 0, spaced), F.when(doc % 19 == 0, "").when(doc % 17 != 0, spaced)
            ).alias("article_title"),
            pair(link, F.concat(link, F.lit("/ja"))).alias("article_link"),
            pair(
                names(lambda name: F.replace(name, F.lit("#"), F.lit("  #"))),
                names(lambda name: F.concat(F.lit("著者\n"), name)),
            ).alias("author"),
            F.when(doc % 29 != 0, c("o_custkey").cast("string")).alias("volume"),
            (c("o_orderkey") % 12).cast("string").alias("number"),
            F.format_string("%03d", doc).alias("startingPage"),
            F.format_string("%03d", doc + 9).alias("endingPage"),
            F.year("o_orderdate").cast("string").alias("pubyear"),
            F.concat(F.lit("10.0/"), doc.cast("string")).alias("doi"),
        )
    )


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _pages_of_50(rows: DataFrame, key: str, render) -> DataFrame:
    """``page`` and ``body``: the texts that ``render`` makes of up to 50 neighbouring rows, in key order."""
    listed = F.array_sort(F.collect_list(F.struct(key, *[c for c in rows.columns if c != key])))
    paged = rows.groupBy(F.expr(f"{key} div 50").alias("page")).agg(listed.alias("rows"))
    return paged.select("page", F.array_join(F.transform("rows", render), "").alias("body"))


def feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Articles as XML feeds of up to 50 entries. Some feeds count fewer results than they hold, some more."""

    def element(name: str, text: Column) -> Column:
        filled = F.concat(F.lit(f"<{name}>"), _escaped(text), F.lit(f"</{name}>"))
        return F.coalesce(filled, F.lit(f"<{name}/>"))

    def both(name: str, inner) -> list[Column]:
        start, end = F.lit(f"<{name}>\n<en>"), F.lit(f"</ja></{name}>")
        return [start, inner("en"), F.lit("</en>\n<ja>"), inner("ja"), end]

    def entry(r: Column) -> Column:
        def authors(lang: str) -> Column:
            listed = F.transform(r["author"][lang]["name"], lambda name: element("name", name))
            return F.coalesce(F.array_join(listed, "\n"), F.lit(""))

        plain = ["volume", "number", "startingPage", "endingPage", "pubyear", "doi"]
        return F.concat(
            F.lit("<entry>\n"),
            *both("article_title", lambda lang: F.coalesce(_escaped(r["article_title"][lang]), F.lit(""))),
            *both("article_link", lambda lang: _escaped(r["article_link"][lang])),
            *both("author", authors),
            *[element(name, r[name]) for name in plain],
            F.lit("</entry>\n"),
        )

    paged = _pages_of_50(articles(spark, folder), "doc_id", entry)
    total = F.when(F.col("page") % 3 == 0, 45).when(F.col("page") % 3 == 1, 50).otherwise(60)
    xml = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom">\n<totalResults>'),
        total.cast("string"),
        F.lit("</totalResults>\n"),
        F.col("body"),
        F.lit("</feed>"),
    )
    return paged.select(F.col("page").alias("feed_id"), xml.alias("xml"))


def feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """The feeds as file texts; some have no count of results, some break off."""
    uncounted = F.regexp_replace("xml", "<totalResults>[0-9]+</totalResults>\n", "")
    broken = F.expr("substring(xml, 1, length(xml) - 30)")
    feed = F.col("feed_id")
    text = F.when(feed % 5 == 4, uncounted).when(feed % 7 == 3, broken).otherwise(F.col("xml"))
    return feeds(spark, folder).select("feed_id", text.alias("value"))


def contents_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents listed on contents pages of up to 50 articles, with a heading before every tenth."""

    def item(r: Column) -> Column:
        doc = r["doc_id"]
        number = doc.cast("string")
        tenth = F.call_function("div", doc, F.lit(10)).cast("string")
        heading = F.concat(F.lit('<h2 class="lead section-level1">\n原著 '), tenth, F.lit("</h2>"))
        author = F.concat(F.lit("<div class=searchlist-authortags>Ed: &amp; "), r["source"], F.lit("<br></div>"))
        return F.concat(
            F.when(doc % 10 == 0, heading).otherwise(""),
            F.lit('\n<li>\n  <div class="searchlist-title">\n\t<b> No. '),
            number,
            F.lit(" </b>　"),
            _escaped(F.replace(r["text"], F.lit(", "), F.lit(" +"))),
            F.lit(" </div>"),
            F.when(doc % 7 == 0, "").otherwise(author),
            F.lit("<p class='x searchlist-additional-info'>p.&#160;"),
            number,
            F.lit("&ndash;\n\t9<!-- n --></p><script>var a='</p>';</script></li>"),
        )

    documents = given(spark, folder, "documents")["documents"]
    paged = _pages_of_50(documents.select("doc_id", "text", "source"), "doc_id", item)
    html = F.concat(
        F.lit('<!DOCTYPE html><html><body><ul><li>menu</li></ul><div id="search-resultslist-wrap"><ul>'),
        F.col("body"),
        F.lit("</ul></div></body></html>"),
    )
    return paged.select(F.col("page").alias("page_id"), html.alias("html"))
