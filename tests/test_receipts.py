import pytest

from eventdocs.operators import receipts
from eventdocs.schemas import RECEIPT_EVENT, ROSTER

LINES = [f"行{i}" for i in range(10)]
EVENT = (1, "領収書", "第1回大会", "委員会", "会長", "2025年10月10日", LINES, ["事務局", ""], 501, 493)


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([EVENT], RECEIPT_EVENT)


def test_items_of_the_two_attendees(two_attendees, events):
    items = receipts.with_proviso(receipts.receipt_items(two_attendees), events)
    rows = items.orderBy("entry_no", "slot_no").collect()
    assert [(r["entry_no"], r["slot_no"], r["y_mm"]) for r in rows] == [
        (1, 0, 286), (1, 1, 216), (1, 2, 146), (2, 0, 286), (2, 2, 146)
    ]
    assert rows[0]["amount_text"] == "￥4,000－"
    assert rows[0]["recipient"] == "参加者1 様"
    assert rows[1]["proviso"] == "ただし，第1回大会懇親会参加費として"


@pytest.mark.parametrize(
    "fee, text", [(0, None), (None, None), (-4000, "￥-4,000－"), (999, "￥999－"), (1234567, "￥1,234,567－")]
)
def test_amounts(spark, fee, text):
    roster = spark.createDataFrame([(1, 1, "n", "a", "m", fee, 0, 0, 0)], ROSTER)
    assert [r["amount_text"] for r in receipts.receipt_items(roster).collect()] == ([text] if text else [])


def test_fees_are_called_by_the_rosters_own_headers(spark, two_attendees):
    from pyspark.sql import functions as F

    named = two_attendees.withColumn("fee_labels", F.array(F.lit("A"), F.lit("B"), F.lit("C")))
    rows = receipts.receipt_items(named).orderBy("entry_no", "slot_no").collect()
    assert [r["fee_label"] for r in rows] == ["A", "B", "C", "A", "C"]


def test_pages_include_attendees_without_fees(spark):
    rows = [(1, 4, "a", "", "m", 0, 0, None, 0), (1, 9, "b", "", "m", 1, 0, -2, 0), (2, 1, "c", "", "m", 0, 3, 0, 0)]
    pages = receipts.receipt_pages(spark.createDataFrame(rows, ROSTER)).orderBy("event_id", "entry_no").collect()
    assert [(r["page_no"], r["receipts"]) for r in pages] == [(1, 0), (2, 2), (1, 1)]


def test_footers_keep_eight_lines_and_empty_ones(two_attendees, events):
    rows = receipts.receipt_footers(two_attendees, events).where("entry_no = 2").orderBy("side", "line_no").collect()
    left = [(r["x_mm"], r["y_mm"], r["text"]) for r in rows if r["side"] == 1]
    assert left == [(10 if i == 0 else 15, 47 - 5 * i, f"行{i}") for i in range(8)]
    assert [(r["x_mm"], r["y_mm"], r["text"]) for r in rows if r["side"] == 2] == [(125, 47, "事務局"), (130, 42, "")]


def test_elements(two_attendees, events):
    items = receipts.receipt_items(two_attendees)
    drawn = receipts.receipt_elements(items, events)
    rows = {r["element"]: r for r in drawn.where("entry_no = 1 and slot_no = 1").collect()}
    assert len(rows) == 10
    stamp, amount, recipient = rows["stamp"], rows["amount"], rows["recipient"]
    assert (stamp["x_mm"], stamp["y_mm"], stamp["width_mm"]) == (154, 151, 22)
    assert stamp["height_mm"] == pytest.approx(22 * 493 / 501)
    assert amount["box"] == "rect" and amount["bg_color"] == "lightgrey"
    assert amount["text_x_pt"] == pytest.approx((56 + 49) * 72 / 25.4)
    assert recipient["box"] == "underline" and recipient["line_width_mm"] == 0.3
    assert recipient["box_y_pt"] == pytest.approx((216 - 15 - 1) * 72 / 25.4)
    assert rows["frame"]["kind"] == "frame" and rows["frame"]["height_mm"] == 66
    assert rows["received"]["y_mm"] == 216 - 48.5
    assert receipts.receipt_elements(items, events, stamped=False).where("element = 'stamp'").count() == 0


def test_event_without_image_has_no_stamp(spark, two_attendees):
    events = spark.createDataFrame([EVENT[:-2] + (None, None)], RECEIPT_EVENT)
    drawn = receipts.receipt_elements(receipts.receipt_items(two_attendees), events)
    assert drawn.count() == 5 * 9


def test_blank_receipts(spark):
    rows = [(1, "大会", ["参加費", "現地研修会参加費"]), (2, "大会", []), (3, "大会", ["懇親会参加費", "other"])]
    events = spark.createDataFrame(rows, "event_id BIGINT, congress STRING, items ARRAY<STRING>")
    got = receipts.receipt_blank(events).orderBy("event_id", "slot_no").collect()
    assert [(r["event_id"], r["slot_no"], r["y_mm"]) for r in got] == [(1, 0, 286), (1, 2, 146), (3, 1, 216)]
    assert got[0]["recipient"] == " " * 16 + " 様" and got[0]["amount_text"] == "￥" + " " * 14
    assert got[1]["proviso"] == "ただし，大会現地研修会参加費として"
