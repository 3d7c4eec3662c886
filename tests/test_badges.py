import pytest
from pyspark.sql import functions as F

from eventdocs import layout
from eventdocs.operators.badges import badge_blank, badge_elements, badge_layout, badge_sheets
from eventdocs.schemas import BADGE_EVENT, ROSTER

EVENT = (1, "第1回大会", "2025年10月10日", "実行委員会", "委員会", "会館", "所属", "氏名", None)
CORNERS = [(x, y) for x in (14, 105) for y in (286, 231, 176, 121, 66)]


@pytest.mark.parametrize("size", [1, 9, 10, 11, 20, 23])
def test_slots_follow_the_roster(make_roster, size):
    rows = badge_layout(make_roster({1: size}, first=5, step=3)).orderBy("entry_no").collect()
    assert [(r["sheet_no"], r["slot_no"]) for r in rows] == [divmod(i, 10) for i in range(size)]
    assert [(r["x_mm"], r["y_mm"]) for r in rows] == [CORNERS[i % 10] for i in range(size)]


def test_events_are_numbered_apart(make_roster):
    both = make_roster({1: 12, 2: 25})
    whole = badge_layout(both).orderBy("event_id", "entry_no").collect()
    alone = [r for e in (1, 2) for r in badge_layout(both.where(f"event_id = {e}")).orderBy("entry_no").collect()]
    assert whole == alone


def test_blank_last_page_when_sheets_are_full(spark, make_roster):
    sizes = {1: 1, 2: 9, 3: 10, 4: 11, 5: 20}
    events = spark.createDataFrame([(e,) for e in [*sizes, 6]], "event_id BIGINT")
    rows = {r["event_id"]: r for r in badge_sheets(make_roster(sizes), events).collect()}
    assert {e: r["pages_emitted"] for e, r in rows.items()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 1}
    assert {e: r["sheets_needed"] for e, r in rows.items()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 0}
    assert {r["event_id"] for r in badge_sheets(make_roster(sizes)).collect()} == set(sizes)


@pytest.mark.parametrize(
    "affiliation, size", [(None, None), ("", None), ("支援大学", 20.0), ("あ" * 10, 20.0), ("あ" * 21, 10.0), ("𠮷" * 42, 5.0)]
)
def test_affiliation_font(spark, affiliation, size):
    roster = spark.createDataFrame([(1, 1, "n", affiliation, "m", 0, 0, 0, 0)], ROSTER)
    assert badge_layout(roster).first()["affil_font"] == size


@pytest.mark.parametrize("fee, mark", [(None, False), (-1, False), (0, False), (1, True)])
def test_marks_need_a_positive_fee(spark, fee, mark):
    roster = spark.createDataFrame([(1, 1, "n", "a", "m", 0, fee, fee, 0)], ROSTER)
    row = badge_layout(roster).first()
    assert row["dinner_mark"] is mark and row["workshop_mark"] is mark


def test_elements_of_the_two_attendees(spark, two_attendees):
    events = spark.createDataFrame([EVENT], BADGE_EVENT)
    rows = badge_elements(badge_layout(two_attendees), events).collect()
    first = {r["element"]: r for r in rows if r["entry_no"] == 1}
    second = {r["element"]: r for r in rows if r["entry_no"] == 2}
    assert [r["element_no"] for r in rows if r["entry_no"] == 1] == list(range(1, 14))
    assert set(first) - set(second) == {"dinner_mark"}
    strip = first["congress"]
    assert (strip["x_mm"], strip["y_mm"], strip["bg_color"], strip["box"]) == (15, 276, "green", "rect")
    assert strip["box_x_pt"] == pytest.approx(15 * 72 / 25.4 - 7) and strip["box_h_pt"] == 28
    assert strip["box_w_pt"] == pytest.approx(91 * 72 / 25.4)
    mark = first["dinner_mark"]
    assert (mark["text"], mark["box"], mark["box_r_pt"]) == ("懇", "circle", 9)
    assert mark["box_x_pt"] == pytest.approx(19 * 72 / 25.4 + 12 * 0.48)
    assert second["affiliation"]["font_size"] == 20 and second["affiliation"]["y_mm"] == 231 - 24
    assert first["rule_name"]["text"] is None and first["rule_name"]["text_x_pt"] is None


def test_badges_without_affiliation_have_no_such_element(spark):
    rows = [(1, 1, "a", None, "m", 0, 0, 0, 0), (1, 2, "b", "", "m", 0, 0, 0, 0)]
    badges = badge_layout(spark.createDataFrame(rows, ROSTER))
    drawn = badge_elements(badges, spark.createDataFrame([EVENT], BADGE_EVENT))
    assert drawn.groupBy("entry_no").count().where("count = 10").count() == 2
    assert drawn.where("element = 'affiliation'").count() == 0


def test_blank_badges(spark):
    events = spark.createDataFrame([(1, 2), (2, 0), (3, None)], "event_id BIGINT, n_sheet BIGINT")
    blank = badge_blank(events)
    counts = {r["event_id"]: r["count"] for r in blank.groupBy("event_id").count().collect()}
    assert counts == {1: 20, 3: 10}
    row = blank.where("event_id = 1 and entry_no = 17").first()
    assert (row["sheet_no"], row["slot_no"], row["x_mm"], row["y_mm"], row["name"]) == (1, 7, 105, 176, "")
    assert row["affil_font"] is None and not row["dinner_mark"]


def test_every_slot_is_used_once(spark, make_roster):
    badges = badge_layout(make_roster({1: 37, 2: 10}))
    assert badges.select("event_id", "sheet_no", "slot_no").distinct().count() == 47
    assert badges.agg(F.max("slot_no")).first()[0] == layout.BADGES_PER_SHEET - 1
