import pytest

from eventdocs.operators import numbering

REQUEST = "id BIGINT, start BIGINT, `end` BIGINT"


def test_session_labels_have_two_digits_at_least(spark):
    requests = spark.createDataFrame([(1, 98, 102), (2, 1, 2), (3, 5, 4)], REQUEST)
    rows = numbering.session_labels(requests, "id").orderBy("id", "number").collect()
    assert [r["label"] for r in rows] == ["A98", "A99", "A100", "A101", "A102", "A01", "A02"]
    assert [r["page_no"] for r in rows] == [1, 2, 3, 4, 5, 1, 2]
    first = rows[0]
    assert (first["x_mm"], first["y_mm"], first["font_size"], first["align"]) == (23, 303 - 23, 30, "left")
    assert (first["page_w_mm"], first["page_h_mm"]) == (216, 303)


def test_page_labels_are_centred(spark):
    requests = spark.createDataFrame(
        [(1, 1, 100, None, 3.0), (2, 7, 7, 15.0, 0.0)], REQUEST + ", x_mm DOUBLE, bleed_mm DOUBLE"
    )
    rows = numbering.page_labels(requests, "id").orderBy("id", "number").collect()
    assert [r["label"] for r in rows] == [f"- {i} -" for i in range(1, 101)] + ["- 7 -"]
    assert (rows[0]["x_mm"], rows[0]["y_mm"]) == (108, 13)
    assert (rows[-1]["x_mm"], rows[-1]["y_mm"]) == (15, 10)
    assert rows[0]["x_pt"] == pytest.approx(108 * 72 / 25.4)


def test_own_prefix_and_suffix(spark):
    requests = spark.createDataFrame([(1, 3, 3, "P", "*")], REQUEST + ", pre STRING, post STRING")
    assert numbering.session_labels(requests, "id").first()["label"] == "P03*"
    assert numbering.page_labels(requests, "id").first()["label"] == "P3*"


def test_missing_bounds_are_one(spark):
    requests = spark.createDataFrame([(1, None, 3), (2, -1, None), (3, None, None), (4, 5, None)], REQUEST)
    for labels in (numbering.session_labels, numbering.page_labels):
        rows = labels(requests, "id").collect()
        assert sorted((r["id"], r["number"]) for r in rows) == [(1, 1), (1, 2), (1, 3), (2, -1), (2, 0), (2, 1), (3, 1)]
        assert {r["page_no"] for r in rows if r["id"] == 2} == {1, 2, 3}
        assert labels(requests.select("id"), "id").count() == 4


@pytest.mark.parametrize("block", [1, 3, 7, 100])
def test_long_ranges_are_dealt_out_whole(spark, block):
    ranges = [(1, 0, 49), (2, -3, 4), (3, 5, 5), (4, 6, 5), (5, 0, block - 1), (6, 0, block)]
    requests = spark.createDataFrame(ranges, REQUEST)
    rows = numbering.expand_range(requests, "start", "end", "n", block=block).collect()
    wanted = [(r["id"], n) for r in requests.collect() for n in range(r["start"], r["end"] + 1)]
    assert sorted((r["id"], r["n"]) for r in rows) == sorted(wanted)


def test_division_and_blank_pages(spark):
    schema = "id BIGINT, kind STRING, text STRING, y_mm DOUBLE, font_size DOUBLE, fill_color STRING, bleed_mm DOUBLE"
    rows = [(1, "division", "第1部", 20.0, 30.0, "red", 3.0), (2, "blank", None, None, None, "greenyellow", 3.0),
            (3, "blank", None, None, None, None, None), (4, "division", "", None, 10.0, None, None)]
    got = {r["id"]: r for r in numbering.page_requests(spark.createDataFrame(rows, schema), "id").collect()}
    strip = got[1]
    assert (strip["strip_y_mm"], strip["strip_w_mm"], strip["strip_h_mm"]) == (303 - 63, 216, 40)
    assert strip["text_x_mm"] == 108 and strip["fill_color"] is None
    assert strip["text_y_pt"] == pytest.approx(260 * 72 / 25.4 - 12)
    assert (got[2]["fill_color"], got[2]["page_w_mm"], got[2]["text"]) == ("greenyellow", 216, None)
    assert (got[3]["page_w_mm"], got[3]["page_h_mm"]) == (210, 297)
    assert (got[4]["page_w_mm"], got[4]["strip_y_mm"]) == (216, 303 - 53)
