import pytest
from pyspark.sql import functions as F

from eventdocs.operators import pages

PAGE = "doc_id STRING, page_no BIGINT, page_w_mm DOUBLE, page_h_mm DOUBLE"
FILE = "job_id BIGINT, file_name STRING, upload_seq BIGINT, status STRING"


def page_rows(spark, files: dict[tuple, int]):
    rows = [(*file, n) for file, count in files.items() for n in range(1, count + 1)]
    return spark.createDataFrame(rows, "job_id BIGINT, file_name STRING, upload_seq BIGINT, page_no BIGINT")


def combined(df):
    rows = df.orderBy("job_id", "out_page").collect()
    return [(r["job_id"], r["out_page"], r["file_name"], r["upload_seq"], r["page_no"]) for r in rows]


def test_overlay_keeps_every_base_page(spark):
    base = spark.createDataFrame([("a", n, 210.0, 297.0) for n in (1, 2, 3)] + [("b", 1, 297.0, 420.0)], PAGE)
    over = spark.createDataFrame(
        [("a", n, 216.0, 303.0) for n in (1, 2)] + [("b", n, 210.0, 297.0) for n in (1, 2)], PAGE
    ).withColumn("label", F.concat("doc_id", "page_no"))
    rows = {(r["doc_id"], r["page_no"]): r for r in pages.page_overlay(base, over).collect()}
    assert {k: r["label"] for k, r in rows.items()} == {("a", 1): "a1", ("a", 2): "a2", ("a", 3): None, ("b", 1): "b1"}
    shrunk = rows["a", 1]
    assert shrunk["scale"] == pytest.approx(210 / 216)
    assert shrunk["offset_x_mm"] == 0 and shrunk["offset_y_mm"] == pytest.approx((297 - 303 * 210 / 216) / 2)
    assert rows["b", 1]["scale"] == pytest.approx(420 / 297, abs=1e-3)
    assert rows["a", 3]["scale"] is None and rows["a", 3]["offset_x_mm"] is None


def test_files_are_combined_in_name_order(spark):
    names = ["b-talks.pdf", "z-end.pdf", "a-front.pdf", "b-posters.pdf"]
    files = {(1, name, i): i + 1 for i, name in enumerate(names)} | {(2, "x.pdf", 0): 3}
    listed = spark.createDataFrame([(*f, "ok") for f in files], FILE)
    got = combined(pages.page_combine(page_rows(spark, files), listed))
    by_name = [(1, "a-front.pdf", 2), (1, "b-posters.pdf", 3), (1, "b-talks.pdf", 0), (1, "z-end.pdf", 1)]
    first = [(*f, n) for f in by_name for n in range(1, files[f] + 1)]
    assert got[:10] == [(1, i, name, seq, n) for i, (_, name, seq, n) in enumerate(first, start=1)]
    assert got[10:] == [(2, i, "x.pdf", 0, i) for i in (1, 2, 3)]
    as_listed = combined(pages.page_combine(page_rows(spark, files), listed, order=pages.BY_LIST))
    assert [row[2] for row in as_listed[:10]] == [n for i, n in enumerate(names) for _ in range(i + 1)]


def test_same_names_keep_their_upload_order(spark):
    files = {(1, "a.pdf", 7): 2, (1, "a.pdf", 3): 1}
    listed = spark.createDataFrame([(*f, "ok") for f in files], FILE)
    got = combined(pages.page_combine(page_rows(spark, files), listed))
    assert [row[3] for row in got] == [3, 7, 7]


def test_unreadable_files_are_skipped_and_reported(spark):
    files = {(1, "a.pdf", 0): 2, (1, "b.pdf", 0): 4, (1, "c.pdf", 0): 1}
    status = {"a.pdf": "ok", "b.pdf": "broken", "c.pdf": "ok"}
    listed = spark.createDataFrame([(*f, status[f[1]]) for f in files] + [(1, "d.pdf", 0, None)], FILE)
    got = combined(pages.page_combine(page_rows(spark, files), listed))
    assert [row[1:3] for row in got] == [(1, "a.pdf"), (2, "a.pdf"), (3, "c.pdf")]
    messages = {r["message"] for r in pages.page_combine_rejects(listed).collect()}
    assert messages == {"skipped b.pdf: broken", "skipped d.pdf: unknown"}


def test_names_sort_by_code_point(spark):
    names = ["b.pdf", "a10.pdf", "a2.pdf", "B.pdf", "あ.pdf", "ア.pdf", "𠮷.pdf", "～.pdf"]
    files = {(1, name, 0): 1 for name in names}
    listed = spark.createDataFrame([(*f, "ok") for f in files], FILE)
    got = combined(pages.page_combine(page_rows(spark, files), listed))
    assert [row[2] for row in got] == sorted(names)


@pytest.mark.parametrize("numbers", [[1, 3], [0, 1], [2, 3], [1, None], [1, 1, 3], [1, 2, 2, 4, 6, 6], [-5, 1], [None]])
@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_files_with_other_page_numbers_are_skipped_and_reported(spark, numbers, broadcast):
    schema = "job_id BIGINT, file_name STRING, upload_seq BIGINT, page_no BIGINT"
    rows = [(1, "a.pdf", 0, n) for n in numbers] + [(1, "b.pdf", None, n) for n in (1, 2)] + [(1, "c.pdf", 2, 7)]
    rows = spark.createDataFrame(rows, schema)
    listed = spark.createDataFrame([(1, "a.pdf", 0, "ok"), (1, "b.pdf", None, "ok"), (1, "c.pdf", 2, "broken")], FILE)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        assert combined(pages.page_combine(rows, listed)) == [(1, 1, "b.pdf", None, 1), (1, 2, "b.pdf", None, 2)]
        messages = {r["message"] for r in pages.page_combine_rejects(listed, rows).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert messages == {"skipped a.pdf: page numbers are not 1, 2, ...", "skipped c.pdf: broken"}


def test_large_files_are_checked_by_slices(spark):
    numbers = spark.range(1, 100_001).select(F.col("id").alias("page_no"))
    good = numbers.select(F.lit(1).cast("bigint").alias("job_id"), F.lit("a").alias("file_name"),
                          F.lit(0).cast("bigint").alias("upload_seq"), "page_no")
    bad = good.withColumns({"file_name": F.lit("b"), "page_no": F.when(F.col("page_no") == 70_000, 3).otherwise(F.col("page_no"))})
    listed = spark.createDataFrame([(1, "a", 0, "ok"), (1, "b", 0, "ok")], FILE)
    out = pages.page_combine(good.unionByName(bad), listed)
    assert out.count() == 100_000 and out.where("out_page <> page_no OR file_name <> 'a'").count() == 0


def test_a_file_comes_wherever_a_list_names_it(spark):
    rows = spark.createDataFrame([(1, f, n) for f, k in (("a", 2), ("b", 1), ("lost", 3)) for n in range(1, k + 1)] + [(2, None, 1)],
                                 "job_id BIGINT, file_name STRING, page_no BIGINT")
    places = [(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, "a", 5), (1, "a", 5), (1, "none", 4), (3, "a", 1)]
    listed = spark.createDataFrame([(*p, "ok") for p in places], FILE)
    got = pages.page_combine(rows, listed, order=pages.BY_LIST, by=pages.BY_FILE).orderBy("out_page").collect()
    assert [(r["file_name"], r["page_no"]) for r in got] == [("b", 1), ("a", 1), ("a", 2), ("b", 1), *[("a", 1), ("a", 2)] * 2]
    assert [r["out_page"] for r in got] == list(range(1, 9))
    found = {tuple(r) for r in pages.page_combine_rejects(listed, rows, by=pages.BY_FILE).collect()}
    assert found == {
        (1, "none", 4, "ok", "skipped none: no pages"), (3, "a", 1, "ok", "skipped a: no pages"),
        (1, "lost", None, None, "skipped lost: not in the list"), (2, None, None, None, "skipped a file without a name: not in the list"),
    }


def test_one_of_equal_uploads_comes_as_often_as_it_is_listed(spark):
    listed = spark.createDataFrame([(1, "a", 0, "ok")] * 3, FILE)
    got = combined(pages.page_combine(page_rows(spark, {(1, "a", 0): 2, (1, "b", 0): 1}), listed))
    assert [row[1:] for row in got] == [(i + 1, "a", 0, i % 2 + 1) for i in range(6)]
    messages = {r["message"] for r in pages.page_combine_rejects(listed, page_rows(spark, {(1, "a", 0): 2, (1, "b", 9): 1})).collect()}
    assert messages == {"skipped b: not in the list"}


def test_doubled_overlay_pages_double_no_base_page(spark):
    base = spark.createDataFrame([("a", 1, 210.0, 297.0), ("a", 1, 210.0, 297.0), ("a", 2, 210.0, 297.0), ("b", 1, 210.0, 297.0)], PAGE)
    labels = [("a", 1, "x"), ("a", 1, "w"), ("a", 1, None), ("a", 5, "y"), ("a", 5, "y"), ("b", None, "n"), (None, 1, "n")]
    over = spark.createDataFrame([(d, n, 210.0, 297.0, label) for d, n, label in labels], PAGE + ", label STRING")
    rows = [(r["doc_id"], r["page_no"], r["label"]) for r in pages.page_overlay(base, over).collect()]
    assert sorted(rows, key=str) == [("a", 1, "w"), ("a", 1, "w"), ("a", 2, None), ("b", 1, None)]
    found = {tuple(r) for r in pages.page_overlay_rejects(base, over).collect()}
    assert found == {("a", 1, "doubled", 2), ("a", 5, "beyond the base", 2), ("b", None, "no number", 1), (None, 1, "no number", 1)}
