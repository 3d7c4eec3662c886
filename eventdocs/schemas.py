"""Table schemas. Row order is always a column; nothing here relies on file order."""

from __future__ import annotations

ROSTER_COLUMNS = ("name", "affiliation", "member_type", "fee_attend", "fee_dinner", "fee_workshop", "total")
FEE_COLUMNS = ("fee_attend", "fee_dinner", "fee_workshop")

ROSTER_FILE = (
    "name STRING, affiliation STRING, member_type STRING, "
    "fee_attend BIGINT, fee_dinner BIGINT, fee_workshop BIGINT, total BIGINT"
)
ROSTER = f"event_id BIGINT, entry_no BIGINT, {ROSTER_FILE}"

BADGE_EVENT = (
    "event_id BIGINT, congress STRING, event_date STRING, committee STRING, committee_sub STRING, place STRING, "
    "label_affiliation STRING, label_name STRING, strip_color STRING"
)
RECEIPT_EVENT = (
    "event_id BIGINT, title STRING, congress STRING, committee_sub STRING, president STRING, receipt_date STRING, "
    "footer_1 ARRAY<STRING>, footer_2 ARRAY<STRING>, image_width BIGINT, image_height BIGINT"
)

_BILINGUAL = "STRUCT<en: STRING, ja: STRING>"
_NAMES = "STRUCT<name: ARRAY<STRING>>"
FEED_ENTRY = (
    f"article_title {_BILINGUAL}, article_link {_BILINGUAL}, author STRUCT<en: {_NAMES}, ja: {_NAMES}>, "
    "volume STRING, number STRING, startingPage STRING, endingPage STRING, pubyear STRING, doi STRING"
)
FEED = f"totalResults BIGINT, entry ARRAY<STRUCT<{FEED_ENTRY}>>"

CONTENTS_ITEM = "kind STRING, text STRING, title STRING, author STRING, add_info STRING"
