"""The same queries in plain SQL over the given tables, for a check by another engine."""

from __future__ import annotations

from eventdocs.plans import fixtures

_TABLES = {name: name for name in fixtures.TABLES}


def _cte(name: str, sql: str) -> str:
    return f"{name} AS ({sql.format(**_TABLES)})"


_ROSTER = _cte("roster", fixtures.ROSTER_SQL)
_BADGE_EVENTS = _cte("badge_events", fixtures.BADGE_EVENTS_SQL)
_RECEIPT_EVENTS = _cte("receipt_events", fixtures.RECEIPT_EVENTS_SQL)
_HOSTS = _cte("hosts", fixtures.HOSTS_SQL)
_SESSIONS = _cte("sessions", fixtures.SESSIONS_SQL)
_MANUSCRIPTS = _cte("manuscripts", fixtures.MANUSCRIPTS_SQL)
_REQUESTS = _cte("requests", fixtures.PAGE_REQUESTS_SQL)
_FILES = _cte("files", fixtures.FILES_SQL)
_LISTS = _cte("lists", fixtures.LISTS_SQL)
_SIGN_UPS = _cte("sign_ups", fixtures.SIGN_UPS_SQL)

_NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY entry_no) - 1 AS ord FROM roster)"

_LAYOUT = """
SELECT event_id, entry_no, ord // 10 AS sheet_no, ord % 10 AS slot_no,
  14 + 91 * ((ord % 10) // 5) AS x_mm, 286 - 55 * (ord % 5) AS y_mm, name, affiliation,
  CASE WHEN affiliation <> '' THEN least(210::DOUBLE / length(affiliation), 20::DOUBLE) END AS affil_font,
  coalesce(fee_dinner > 0, false) AS dinner_mark, coalesce(fee_workshop > 0, false) AS workshop_mark
FROM numbered
"""

_ITEMS = """
items AS (
  SELECT event_id, entry_no, slot_no, 14::BIGINT AS x_mm, (286 - 70 * slot_no)::BIGINT AS y_mm,
    name || ' 様' AS recipient, '￥' || format('{:,}', amount) || '－' AS amount_text, fee_label
  FROM (
    SELECT event_id, entry_no, name, 0::BIGINT AS slot_no, '参加費' AS fee_label, fee_attend AS amount FROM roster
    UNION ALL SELECT event_id, entry_no, name, 1, '懇親会参加費', fee_dinner FROM roster
    UNION ALL SELECT event_id, entry_no, name, 2, '研修会参加費', fee_workshop FROM roster)
  WHERE amount <> 0)
"""

# Points and boxes of an element list with x_mm, y_mm, width_mm, font_size, shape, bg_color, align, kind.
_DRAWN = """
SELECT {keep}, element_no::BIGINT AS element_no, element, kind, text, x_mm, y_mm, width_mm, height_mm, line_width_mm,
  CASE WHEN kind = 'text' THEN 'GenShinGothic' END AS font_name, font_size, color, bg_color, align,
  CASE WHEN kind = 'text' THEN CASE align WHEN 'center' THEN x_pt + w_pt * 0.5::DOUBLE ELSE x_pt END END AS text_x_pt,
  CASE WHEN kind = 'text' THEN y_pt END AS text_y_pt,
  box,
  CASE box WHEN 'rect' THEN x_pt - font_size * 0.5::DOUBLE WHEN 'circle' THEN x_pt + font_size * 0.48::DOUBLE
    WHEN 'underline' THEN x_pt END AS box_x_pt,
  CASE box WHEN 'rect' THEN y_pt - font_size * 0.5::DOUBLE WHEN 'circle' THEN y_pt + font_size * 0.38::DOUBLE
    WHEN 'underline' THEN y_pt - 1::DOUBLE * 72::DOUBLE / 25.4::DOUBLE END AS box_y_pt,
  CASE WHEN box IN ('rect', 'underline') THEN w_pt END AS box_w_pt,
  CASE box WHEN 'rect' THEN font_size * 2::DOUBLE END AS box_h_pt,
  CASE box WHEN 'circle' THEN font_size * 0.75::DOUBLE END AS box_r_pt
FROM (
  SELECT *, x_mm * 72::DOUBLE / 25.4::DOUBLE AS x_pt, y_mm * 72::DOUBLE / 25.4::DOUBLE AS y_pt,
    width_mm * 72::DOUBLE / 25.4::DOUBLE AS w_pt,
    CASE WHEN shape = 'underlined' THEN 'underline' WHEN bg_color <> 'white' THEN shape END AS box
  FROM placed)
"""

_BADGE_TEMPLATE = """
tpl(element_no, element, kind, dx, dy, width_mm, fs, color, shape, bg) AS (VALUES
  (1, 'congress', 'text', 1.0, -10.0, 91.0, 14.0, 'white', 'rect', NULL),
  (2, 'place', 'text', 65, -10, NULL, 7, 'white', NULL, NULL),
  (3, 'date', 'text', 65, -6, NULL, 7, 'white', NULL, NULL),
  (4, 'label_affiliation', 'text', 2, -15, NULL, 6, 'black', NULL, NULL),
  (5, 'label_name', 'text', 2, -30, NULL, 6, 'black', NULL, NULL),
  (6, 'rule_affiliation', 'line', 2, -25, 78, NULL, NULL, NULL, NULL),
  (7, 'rule_name', 'line', 2, -40, 78, NULL, NULL, NULL, NULL),
  (8, 'affiliation', 'text', 2, -24, NULL, NULL, 'black', NULL, NULL),
  (9, 'name', 'text', 2, -39, NULL, 24, 'black', NULL, NULL),
  (10, 'dinner_mark', 'text', 5, -47, NULL, 12, 'white', 'circle', 'red'),
  (11, 'workshop_mark', 'text', 12, -47, NULL, 12, 'white', 'circle', 'blue'),
  (12, 'committee', 'text', 45, -45, NULL, 6, 'black', NULL, NULL),
  (13, 'committee_sub', 'text', 45, -48, NULL, 6, 'black', NULL, NULL))
"""

_BADGE_PLACED = """
placed AS (
  SELECT event_id, entry_no, sheet_no, slot_no, element_no, element, kind,
    CASE element WHEN 'congress' THEN congress WHEN 'place' THEN place WHEN 'date' THEN event_date
      WHEN 'label_affiliation' THEN label_affiliation WHEN 'label_name' THEN label_name
      WHEN 'affiliation' THEN affiliation WHEN 'name' THEN name WHEN 'dinner_mark' THEN '懇'
      WHEN 'workshop_mark' THEN '研' WHEN 'committee' THEN committee WHEN 'committee_sub' THEN committee_sub
    END AS text,
    x_mm + dx::DOUBLE AS x_mm, y_mm + dy::DOUBLE AS y_mm, width_mm::DOUBLE AS width_mm, NULL::DOUBLE AS height_mm,
    NULL::DOUBLE AS line_width_mm, CASE WHEN element = 'affiliation' THEN affil_font ELSE fs::DOUBLE END AS font_size,
    color, shape, CASE WHEN element = 'congress' THEN coalesce(strip_color, 'green') ELSE bg END AS bg_color,
    CASE WHEN kind = 'text' THEN 'left' END AS align
  FROM lay JOIN {events} USING (event_id) CROSS JOIN tpl
  WHERE CASE element WHEN 'affiliation' THEN coalesce(affiliation <> '', false) WHEN 'dinner_mark' THEN dinner_mark
    WHEN 'workshop_mark' THEN workshop_mark ELSE true END)
"""


def _badge_elements(rows: str, events: str) -> str:
    """Elements of the badges numbered by the CTEs ``rows``, with the constants of the CTE ``events``."""
    drawn = _DRAWN.format(keep="event_id, entry_no, sheet_no, slot_no")
    placed = _BADGE_PLACED.format(events=events)
    return f"WITH {rows}, lay AS ({_LAYOUT}), {_BADGE_TEMPLATE}, {placed} {drawn}"


_RECEIPT_TEMPLATE = """
tpl(element_no, element, kind, dx, dy, width_mm, font_size, color, shape, bg_color, align, lw) AS (VALUES
  (1, 'stamp', 'image', 140.0, -65.0, 22.0, NULL, NULL, NULL, NULL, NULL, NULL),
  (2, 'frame', 'frame', 0, -66, 182, NULL, NULL, NULL, NULL, NULL, 0.2),
  (3, 'title', 'text', 42, -7, 98, 12, 'black', NULL, NULL, 'center', NULL),
  (4, 'recipient', 'text', 42, -15, 98, 13, 'black', 'underlined', NULL, 'center', 0.3),
  (5, 'amount', 'text', 42, -28, 98, 13, 'black', 'rect', 'lightgrey', 'center', NULL),
  (6, 'proviso', 'text', 42, -39, 98, 10, 'black', 'underlined', NULL, 'center', 0.3),
  (7, 'date', 'text', 45, -45, NULL, 10, 'black', NULL, NULL, 'left', NULL),
  (8, 'received', 'text', 45, -48.5, NULL, 10, 'black', NULL, NULL, 'left', NULL),
  (9, 'committee_sub', 'text', 105, -58, NULL, 10, 'black', NULL, NULL, 'left', NULL),
  (10, 'president', 'text', 118, -61.5, NULL, 10, 'black', NULL, NULL, 'left', NULL))
"""

_RECEIPT_PLACED = """
placed AS (
  SELECT event_id, entry_no, slot_no, element_no, element, kind,
    CASE element WHEN 'title' THEN title WHEN 'recipient' THEN recipient WHEN 'amount' THEN amount_text
      WHEN 'proviso' THEN 'ただし，' || congress || fee_label || 'として' WHEN 'date' THEN receipt_date
      WHEN 'received' THEN '上記正に領収いたしました。' WHEN 'committee_sub' THEN committee_sub
      WHEN 'president' THEN president END AS text,
    x_mm + dx::DOUBLE AS x_mm, y_mm + dy::DOUBLE AS y_mm, width_mm::DOUBLE AS width_mm,
    CASE element WHEN 'stamp' THEN 22::DOUBLE * image_height / image_width WHEN 'frame' THEN 66::DOUBLE END AS height_mm,
    lw::DOUBLE AS line_width_mm, font_size::DOUBLE AS font_size, color, shape, bg_color, align
  FROM items JOIN {events} USING (event_id) CROSS JOIN tpl
  WHERE element <> 'stamp' OR {stamped})
"""


def _receipt_elements(rows: str, events: str, stamped: str) -> str:
    """Elements of the receipts in the CTE ``items`` of ``rows``, with the constants of the CTE ``events``."""
    drawn = _DRAWN.format(keep="event_id, entry_no, slot_no")
    placed = _RECEIPT_PLACED.format(events=events, stamped=stamped)
    return f"WITH {rows}, {_RECEIPT_TEMPLATE}, {placed} {drawn}"


_BLANK_NUMBERED = """
numbered AS (
  SELECT event_id, ord, ord AS entry_no, '' AS name, '' AS affiliation, 0 AS fee_dinner, 0 AS fee_workshop
  FROM (SELECT event_id, unnest(range(0, n_sheet * 10)) AS ord FROM hosts))
"""

_BLANK_ITEMS = """
items AS (
  SELECT event_id, 0::BIGINT AS entry_no, slot_no, 14::BIGINT AS x_mm, (286 - 70 * slot_no)::BIGINT AS y_mm,
    repeat(' ', 16) || ' 様' AS recipient, '￥' || repeat(' ', 14) AS amount_text, fee_label
  FROM hosts JOIN (VALUES (0::BIGINT, '参加費'), (1, '懇親会参加費'), (2, '現地研修会参加費')) s(slot_no, fee_label)
    ON list_contains(string_split(items_text, ','), fee_label))
"""

_FOOTER_LINES = """
lines AS (
  SELECT event_id, side, line_no,
    (CASE side WHEN 1 THEN 10 ELSE 125 END + CASE WHEN line_no = 0 THEN 0 ELSE 5 END)::BIGINT AS x_mm,
    (47 - 5 * line_no)::BIGINT AS y_mm, 11::DOUBLE AS font_size, text
  FROM (
    SELECT event_id, 1::BIGINT AS side, unnest(string_split(footer_text_1, chr(10))) AS text,
      generate_subscripts(string_split(footer_text_1, chr(10)), 1) - 1 AS line_no FROM {events}
    UNION ALL
    SELECT event_id, 2, unnest(string_split(footer_text_2, chr(10))),
      generate_subscripts(string_split(footer_text_2, chr(10)), 1) - 1 FROM {events})
  WHERE line_no < 8)
"""

_ARTICLES = """
au AS (
  SELECT l_orderkey, list(s_name ORDER BY l_linenumber, l_suppkey) AS names
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey),
art AS (
  SELECT doc_id, lang,
    CASE WHEN doc_id % 23 <> 0 THEN '  ' || text || '   .' || chr(10) END AS title_en,
    CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 17 <> 0 THEN '  ' || text || '   .' || chr(10) END AS title_ja,
    'https://example.org/article/' || doc_id AS link, names,
    CASE WHEN doc_id % 29 <> 0 THEN o_custkey::VARCHAR END AS volume, (o_orderkey % 12)::VARCHAR AS number,
    printf('%03d', doc_id) || '-' || printf('%03d', doc_id + 9) AS pages, year(o_orderdate)::VARCHAR AS pubyear
  FROM documents JOIN orders ON o_orderkey = doc_id LEFT JOIN au ON l_orderkey = doc_id)
"""

_CITED_JA = """
cited AS (
  SELECT doc_id, lang, link || '/ja' AS link,
    coalesce(array_to_string(list_transform(names, lambda n: '著者' || n), ', ') || ', ', '')
    || replace(replace(title_ja, '  ', ''), chr(10), '') || '. 植生学会誌, ' || pubyear || ', ' || volume || '巻, '
    || number || '号, p.' || pages AS citation
  FROM art WHERE title_ja <> '' AND volume IS NOT NULL)
"""

_CITED_EN = """
cited AS (
  SELECT doc_id, lang, link,
    coalesce(array_to_string(names, ', '), '') || ', ' || replace(replace(title_en, '  ', ''), chr(10), '')
    || ' Vegetation Science, ' || pubyear || ', Volume' || volume || ', Issue ' || number || ', Pages' || pages
    AS citation
  FROM art WHERE title_en <> '' AND volume IS NOT NULL)
"""

_LISTED = """
SELECT lang, doc_id, idx AS item_index,
  idx || chr(10) || '<li style="margin-left: 40px; padding-bottom: 15px;">' || chr(10) || ' <a href="' || link || '">'
  || chr(10) || '     ' || citation || chr(10) || ' </a>' || chr(10) || '</li>' AS value
FROM cited JOIN (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 + {first} AS idx FROM art)
  USING (doc_id)
"""

_COMBINED = """
WITH raw AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n,
    count(*) OVER (PARTITION BY lang, source) AS pages FROM documents),
paged AS (
  SELECT lang AS job_id, source || '.pdf' AS file_name,
    CASE WHEN source <> 'src5' THEN substr(source, 4)::BIGINT END AS upload_seq, doc_id,
    CASE source WHEN 'src7' THEN CASE WHEN n > 1 THEN n + 1 ELSE n END WHEN 'src11' THEN greatest(n - 1, 1) ELSE n END
      AS page_no
  FROM raw WHERE source <> 'src13' AND (source NOT IN ('src7', 'src11') OR pages = 1))
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {order}) AS out_page FROM paged
"""

_ROSTER_CELLS = f"""{_ROSTER}, cells AS ({fixtures.ROSTER_CELLS_SQL.format(roster="roster")}), numbered AS (
  SELECT * REPLACE (try_cast(replace(replace(fee_attend, ',', ''), '.0', '') AS BIGINT) AS fee_attend,
      fee_dinner::BIGINT AS fee_dinner, fee_workshop::BIGINT AS fee_workshop, total::BIGINT AS total,
      nullif(affiliation, '') AS affiliation),
    row_number() OVER (PARTITION BY event_id ORDER BY entry_no) - 1 AS position
  FROM cells)"""

_FEED_NUMBERED = """
numbered AS (
  SELECT *, doc_id // 50 AS feed_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS ordinal,
    count(*) OVER (PARTITION BY doc_id // 50) AS held,
    CASE (doc_id // 50) % 3 WHEN 0 THEN 45 WHEN 1 THEN 50 ELSE 60 END AS counted
  FROM art)
"""

ORACLE: dict[str, str] = {
    "badge_layout": f"WITH {_ROSTER}, {_NUMBERED} {_LAYOUT}",
    "badge_sheets": f"""
WITH {_ROSTER}, {_BADGE_EVENTS}
SELECT event_id, count(entry_no) AS badges, (count(entry_no) + 9) // 10 AS sheets_needed,
  count(entry_no) // 10 + 1 AS pages_emitted
FROM badge_events LEFT JOIN roster USING (event_id) GROUP BY event_id
""",
    "badge_blank": f"WITH {_HOSTS}, {_BLANK_NUMBERED} {_LAYOUT}",
    "badge_elements": _badge_elements(f"{_ROSTER}, {_BADGE_EVENTS}, {_NUMBERED}", "badge_events"),
    "badge_blank_elements": _badge_elements(f"{_HOSTS}, {_BLANK_NUMBERED}", "hosts"),
    "receipt_items": f"""
WITH {_ROSTER}, {_RECEIPT_EVENTS}, {_ITEMS}
SELECT items.*, 'ただし，' || congress || fee_label || 'として' AS proviso
FROM items JOIN receipt_events USING (event_id)
""",
    "receipt_pages": f"""
WITH {_ROSTER}
SELECT event_id, entry_no, row_number() OVER (PARTITION BY event_id ORDER BY entry_no) AS page_no, name,
  (coalesce(fee_attend <> 0, false)::BIGINT + coalesce(fee_dinner <> 0, false)::BIGINT
   + coalesce(fee_workshop <> 0, false)::BIGINT) AS receipts
FROM roster
""",
    "receipt_footers": f"""
WITH {_ROSTER}, {_RECEIPT_EVENTS}, {_FOOTER_LINES.format(events="receipt_events")}
SELECT event_id, entry_no, side, line_no, x_mm, y_mm, font_size, text FROM roster JOIN lines USING (event_id)
""",
    "receipt_elements": _receipt_elements(
        f"{_ROSTER}, {_RECEIPT_EVENTS}, {_ITEMS}", "receipt_events", "image_width IS NOT NULL"
    ),
    "receipt_blank": f"""
WITH {_HOSTS}, {_BLANK_ITEMS}
SELECT items.*, 'ただし，' || congress || fee_label || 'として' AS proviso FROM items JOIN hosts USING (event_id)
""",
    "receipt_blank_elements": _receipt_elements(f"{_HOSTS}, {_BLANK_ITEMS}", "hosts", "false"),
    "receipt_blank_footers": f"WITH {_HOSTS}, {_FOOTER_LINES.format(events='hosts')} SELECT * FROM lines",
    "session_labels": f"""
WITH {_SESSIONS}
SELECT session_id, number, number - start + 1 AS page_no, pre || printf('%02d', number) || post AS label,
  x_mm, y_mm, x_mm * 72::DOUBLE / 25.4::DOUBLE AS x_pt, y_mm * 72::DOUBLE / 25.4::DOUBLE AS y_pt,
  page_w_mm, page_h_mm, 30::DOUBLE AS font_size, 'GenShinGothic' AS font_name, 'left' AS align
FROM (SELECT *, 20 + bleed_mm AS x_mm, page_h_mm - (20 + bleed_mm) AS y_mm
  FROM (SELECT session_id, pre, post, coalesce(start, 1) AS start, bleed_mm, 210 + bleed_mm * 2 AS page_w_mm,
    297 + bleed_mm * 2 AS page_h_mm, unnest(range(coalesce(start, 1), coalesce("end", 1) + 1)) AS number FROM sessions))
""",
    "page_labels": f"""
WITH {_MANUSCRIPTS}
SELECT doc_id, number, number AS page_no, '- ' || number || ' -' AS label, x_mm, y_mm,
  x_mm * 72::DOUBLE / 25.4::DOUBLE AS x_pt, y_mm * 72::DOUBLE / 25.4::DOUBLE AS y_pt, page_w_mm, page_h_mm,
  font_size, 'GenShinGothic' AS font_name, 'center' AS align
FROM (SELECT doc_id, font_size, 210 + bleed_mm * 2 AS page_w_mm, 297 + bleed_mm * 2 AS page_h_mm,
  coalesce(x_mm, (210 + bleed_mm * 2) / 2) AS x_mm, 10 + bleed_mm AS y_mm,
  unnest(range(coalesce(start, 1), coalesce("end", 1) + 1)) AS number
  FROM manuscripts)
""",
    "page_requests": f"""
WITH {_REQUESTS}
SELECT request_id, kind, page_w_mm, page_h_mm,
  CASE kind WHEN 'division' THEN strip_y_mm END AS strip_y_mm,
  CASE kind WHEN 'division' THEN page_w_mm END AS strip_w_mm,
  CASE kind WHEN 'division' THEN height_mm END AS strip_h_mm, CASE kind WHEN 'division' THEN text END AS text,
  CASE kind WHEN 'division' THEN coalesce(x_mm, page_w_mm / 2) END AS text_x_mm,
  CASE kind WHEN 'division'
    THEN (strip_y_mm + height_mm / 2) * 72::DOUBLE / 25.4::DOUBLE - font_size * 0.4::DOUBLE END AS text_y_pt,
  CASE kind WHEN 'division' THEN font_size END AS font_size,
  CASE kind WHEN 'division' THEN 'GenShinGothic' END AS font_name,
  CASE kind WHEN 'division' THEN 'black' END AS strip_color, CASE kind WHEN 'division' THEN 'white' END AS text_color,
  CASE kind WHEN 'blank' THEN fill_color END AS fill_color
FROM (SELECT request_id, kind, text, x_mm, height_mm, font_size, fill_color, page_w_mm + bleed_mm * 2 AS page_w_mm,
  page_h_mm + bleed_mm * 2 AS page_h_mm, page_h_mm + bleed_mm * 2 - (y_mm + bleed_mm + height_mm) AS strip_y_mm
  FROM requests)
""",
    "page_overlay": """
WITH base AS (
  SELECT lang AS manuscript, doc_id, CASE WHEN doc_id % 3 = 0 THEN 297 ELSE 210 END::DOUBLE AS page_w_mm,
    CASE WHEN doc_id % 3 = 0 THEN 420 ELSE 297 END::DOUBLE AS page_h_mm,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS page_no FROM documents),
marked AS (
  SELECT lang AS manuscript, CASE lang WHEN 'es' THEN count(*) + 5 ELSE count(*) // 2 END AS last
  FROM documents GROUP BY lang),
fitted AS (
  SELECT base.*, '- ' || page_no || ' -' AS lbl, last, least(page_w_mm / 216, page_h_mm / 303) AS s
  FROM base JOIN marked USING (manuscript))
SELECT manuscript, doc_id, page_w_mm, page_h_mm, page_no, CASE WHEN page_no <= last THEN lbl END AS label,
  CASE WHEN page_no <= last THEN s END AS scale,
  CASE WHEN page_no <= last THEN (page_w_mm - 216 * s) / 2 END AS offset_x_mm,
  CASE WHEN page_no <= last THEN (page_h_mm - 303 * s) / 2 END AS offset_y_mm
FROM fitted
""",
    "page_combine": _COMBINED.format(order="file_name, doc_id"),
    "page_combine_listed": _COMBINED.format(order="upload_seq NULLS FIRST, doc_id"),
    "page_combine_rejects": f"""
WITH {_FILES}, held AS (SELECT lang AS job_id, source || '.pdf' AS file_name, count(*) AS n FROM documents GROUP BY ALL)
SELECT files.*, 'skipped ' || file_name || ': ' || CASE WHEN status <> 'ok' THEN status
    ELSE 'page numbers are not 1, 2, ...' END AS message
FROM files JOIN held USING (job_id, file_name)
WHERE status <> 'ok' OR (file_name IN ('src7.pdf', 'src11.pdf') AND n > 1)
""",
    "citation_ja": f"WITH {_ARTICLES}, {_CITED_JA} SELECT doc_id, citation FROM cited",
    "citation_en": f"WITH {_ARTICLES}, {_CITED_EN} SELECT doc_id, citation FROM cited",
    "citation_rejects": f"""
WITH {_ARTICLES}
SELECT doc_id, volume, '10.0/' || doc_id AS doi FROM art WHERE title_ja <> '' AND volume IS NULL
""",
    "citation_html_ja": f"WITH {_ARTICLES}, {_CITED_JA} {_LISTED.format(first=0)}",
    "citation_html_en": f"WITH {_ARTICLES}, {_CITED_EN} {_LISTED.format(first=9)}",
    "feed_entries": f"""
WITH {_ARTICLES},
numbered AS (
  SELECT *, doc_id // 50 AS feed_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS ordinal
  FROM art)
SELECT feed_id, ordinal, title_en, nullif(title_ja, '') AS title_ja, link || '/ja' AS link_ja,
  array_to_string(list_transform(names, lambda n: replace(n, '#', '  #')), '; ') AS authors_en,
  array_to_string(list_transform(names, lambda n: '著者' || chr(10) || n), '; ') AS authors_ja,
  volume, number, printf('%03d', doc_id) AS startingPage, printf('%03d', doc_id + 9) AS endingPage, pubyear,
  '10.0/' || doc_id AS doi
FROM numbered WHERE ordinal < CASE feed_id % 3 WHEN 0 THEN 45 WHEN 1 THEN 50 ELSE 60 END
""",
    "html_items": r"""
WITH li AS (
  SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*><a[^>]*>(.*?)</a></li>', 1) AS l FROM pages)),
h1 AS (
  SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS t,
    len(regexp_extract_all(html, '(?s)<li[^>]*><a[^>]*>(.*?)</a></li>', 1)) AS pos FROM pages),
items AS (SELECT page_id, pos, 'item' AS kind, t FROM li UNION ALL SELECT page_id, pos, 'heading', t FROM h1),
plain AS (
  SELECT page_id, pos, kind, replace(regexp_replace(t, '&amp;?', '&', 'g'), '&quot;', '"') AS t FROM items)
SELECT page_id, pos, kind, CASE WHEN length(t) > 20 THEN '' ELSE t END AS section,
  CASE kind WHEN 'item'
    THEN replace(regexp_replace(trim(t), '[\n\r\t]', '', 'g'), ' +', ' ') END AS title,
  NULL::VARCHAR AS author, NULL::VARCHAR AS add_info
FROM plain
""",
    "contents_items": r"""
WITH listed AS (
  SELECT doc_id // 50 AS page_id, doc_id, 1 AS part, 'item' AS kind, text, source FROM documents
  UNION ALL
  SELECT doc_id // 50, doc_id, 0, 'heading', NULL, NULL FROM documents WHERE doc_id % 10 = 0)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY doc_id, part) - 1 AS pos, kind,
  CASE kind WHEN 'heading' THEN chr(10) || '原著 ' || doc_id // 10 ELSE '' END AS section,
  CASE kind WHEN 'item' THEN 'No. ' || doc_id || replace(regexp_replace(
    regexp_replace(replace(text, ', ', ' +'), '^[\s　]+|[\s　]+$', '', 'g'), '[\n\r\t]', '', 'g'), ' +', ' ')
  END AS title,
  CASE WHEN kind = 'item' AND doc_id % 7 <> 0 THEN 'Ed: & ' || source END AS author,
  CASE kind WHEN 'item' THEN 'p.' || chr(160) || doc_id || '–9' END AS add_info
FROM listed
""",
    "citation_rejects_en": f"""
WITH {_ARTICLES}
SELECT doc_id, volume, '10.0/' || doc_id AS doi FROM art WHERE title_en <> '' AND volume IS NULL
""",
    "feed_citations_ja": f"""
WITH {_ARTICLES}, {_CITED_JA}, {_FEED_NUMBERED}
SELECT feed_id, ordinal, citation FROM numbered JOIN cited USING (doc_id) WHERE ordinal < counted
""",
    "feed_citations_en": f"""
WITH {_ARTICLES}, {_CITED_EN}, {_FEED_NUMBERED}
SELECT feed_id, ordinal, citation FROM numbered JOIN cited USING (doc_id) WHERE ordinal < counted
""",
    "feed_citation_rejects": f"""
WITH {_ARTICLES}, {_FEED_NUMBERED}
SELECT feed_id, ordinal, 'ja' AS lang, '10.0/' || doc_id AS doi FROM numbered
WHERE ordinal < counted AND title_ja <> '' AND volume IS NULL
UNION ALL
SELECT feed_id, ordinal, 'en', '10.0/' || doc_id FROM numbered
WHERE ordinal < counted AND title_en <> '' AND volume IS NULL
""",
    "feed_file_entries": f"""
WITH {_ARTICLES}, {_FEED_NUMBERED}
SELECT feed_id, ordinal, number, '10.0/' || doc_id AS doi FROM numbered
WHERE ordinal < counted AND feed_id % 5 <> 4 AND (feed_id % 7 <> 3 OR ordinal < held - 1)
""",
    "feed_file_rejects": f"""
WITH {_ARTICLES}, {_FEED_NUMBERED}
SELECT DISTINCT feed_id, CASE WHEN feed_id % 5 = 4 THEN 'no count of results' ELSE 'breaks off' END AS reason,
  CASE WHEN feed_id % 5 = 4 THEN held WHEN held - 1 < counted THEN 1 ELSE 0 END AS entries
FROM numbered WHERE feed_id % 5 = 4 OR feed_id % 7 = 3
""",
    "roster_csv": f"""
WITH {_ROSTER_CELLS}
SELECT event_id, position, name, affiliation, member_type, fee_attend, fee_dinner, fee_workshop, total FROM numbered
""",
    "roster_rejects": f"""
WITH {_ROSTER_CELLS}
SELECT event_id, name, 'fee_attend' AS "column", '免除' AS text, 'not an amount' AS reason FROM numbered
WHERE entry_no % 31 = 0
""",
    "roster_fee_labels": f"""
WITH {_ROSTER_CELLS}
SELECT event_id, slot_no, name || ' 様' AS recipient, '￥' || format('{{:,}}', amount) || '－' AS amount_text, fee_label
FROM (
  SELECT event_id, name, 0::BIGINT AS slot_no, CASE event_id % 2 WHEN 0 THEN '参加費' ELSE 'fee' END AS fee_label,
    fee_attend AS amount FROM numbered
  UNION ALL SELECT event_id, name, 1, CASE event_id % 2 WHEN 0 THEN '懇親会参加費' ELSE 'dinner' END, fee_dinner FROM numbered
  UNION ALL SELECT event_id, name, 2, CASE event_id % 2 WHEN 0 THEN '研修会参加費' ELSE 'trip' END, fee_workshop FROM numbered)
WHERE amount <> 0
""",
    "receipt_files": f"WITH {_ROSTER}, {_ITEMS} SELECT * FROM items",
}
ORACLE["badge_files"] = ORACLE["badge_layout"]


def _list_lines(items: str) -> str:
    return f"""
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY item_index, k) - 1 AS line_no, value
FROM (
  SELECT lang, item_index, unnest(string_split(value, chr(10))) AS value,
    generate_subscripts(string_split(value, chr(10)), 1) AS k FROM ({items}))
"""


ORACLE["citation_list_files"] = _list_lines(ORACLE["citation_html_en"])
ORACLE["citation_list_files_ja"] = _list_lines(ORACLE["citation_html_ja"])
ORACLE["citation_list_replaced"] = _list_lines(
    f"SELECT * FROM ({ORACLE['citation_html_en']}) WHERE lang NOT IN ('en', 'es') OR item_index % 5 = 0"
)
ORACLE["contents_files"] = f"SELECT * EXCLUDE (kind) FROM ({ORACLE['contents_items']})"
ORACLE["contents_page_files"] = ORACLE["contents_items"]
ORACLE["badge_files_replaced"] = ORACLE["badge_layout"]
ORACLE["receipt_files_replaced"] = f"""
SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN recipient || ' *' ELSE recipient END AS recipient)
FROM ({ORACLE["receipt_files"]})
"""
ORACLE["page_overlay_doubled"] = ORACLE["page_overlay"]
ORACLE["page_overlay_rejects"] = """
WITH held AS (SELECT lang AS manuscript, count(*) AS n FROM documents GROUP BY lang), numbers AS (
  SELECT manuscript, n, unnest(range(1, CASE manuscript WHEN 'es' THEN n + 6 ELSE n // 2 + 1 END)) AS page_no FROM held)
SELECT manuscript, page_no, CASE WHEN page_no > n THEN 'beyond the base' ELSE 'doubled' END AS reason,
  CASE WHEN page_no > n AND page_no % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS pages
FROM numbers WHERE page_no > n OR page_no % 4 = 0
"""
ORACLE["page_combine_twice"] = f"""
WITH {_LISTS}, paged AS (
  SELECT lang AS job_id, source || '.pdf' AS file_name, doc_id,
    row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS page_no FROM documents)
SELECT paged.*, row_number() OVER (PARTITION BY job_id ORDER BY upload_seq, file_name, page_no) AS out_page
FROM paged JOIN lists USING (job_id, file_name)
"""
ORACLE["page_combine_unmatched"] = f"""
WITH {_LISTS}
SELECT job_id, file_name, upload_seq, status, 'skipped ghost.pdf: no pages' AS message FROM lists WHERE file_name = 'ghost.pdf'
UNION ALL
SELECT DISTINCT lang, 'src2.pdf', NULL::BIGINT, NULL, 'skipped src2.pdf: not in the list' FROM documents WHERE source = 'src2'
"""
ORACLE["roster_ties"] = f"""
WITH {_SIGN_UPS}
SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY entry_no, place, desk) - 1 AS position FROM sign_ups
"""
ORACLE["roster_doubles"] = f"""
WITH {_SIGN_UPS} SELECT event_id, entry_no, count(*) AS times FROM sign_ups GROUP BY ALL HAVING count(*) > 1
"""
ORACLE["event_constants_rejects"] = f"""
WITH {_HOSTS} SELECT event_id, 2::BIGINT AS times FROM hosts WHERE event_id % 3 = 0
"""
ORACLE["roster_fee_label_rejects"] = f"""
WITH {_ROSTER} SELECT event_id, count(DISTINCT entry_no % 2) AS versions FROM roster GROUP BY event_id
HAVING count(DISTINCT entry_no % 2) > 1
"""
_DAMAGED = f"""{_ROSTER}, written AS ({fixtures.DAMAGED_LINES_SQL.format(roster="roster")})"""
ORACLE["roster_damaged"] = f"""
WITH {_DAMAGED}
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY entry_no) - 1 AS position, name,
  nullif(affiliation, '') AS affiliation, member_type, fee_attend, fee_dinner, fee_workshop,
  fee_attend + coalesce(fee_dinner, 0) + fee_workshop AS total
FROM roster JOIN written USING (event_id, entry_no) WHERE entry_no % 23 <> 5 AND line NOT LIKE '"%'
"""
ORACLE["roster_damaged_rejects"] = f"""
WITH {_DAMAGED}
SELECT event_id, NULL::VARCHAR AS "column", line AS text,
  CASE WHEN line LIKE '"%' THEN 'quote not closed' ELSE 'wrong number of cells' END AS reason
FROM written WHERE entry_no % 23 = 5 OR line LIKE '"%'
"""
ORACLE["roster_parquet"] = f"""
WITH {_ROSTER} SELECT *, fee_attend + coalesce(fee_dinner, 0) + fee_workshop AS total FROM roster
"""
ORACLE["roster_parquet_rejects"] = f"""
WITH {_ROSTER} SELECT DISTINCT event_id, 'not readable' AS reason, 0::BIGINT AS rows FROM roster WHERE event_id % 5 = 0
"""
ORACLE["feed_broken_entries"] = f"""
WITH {_ARTICLES}, {_FEED_NUMBERED} SELECT DISTINCT feed_id FROM numbered WHERE feed_id % 7 = 3 AND feed_id % 5 <> 4
"""
