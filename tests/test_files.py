"""Reading and writing files."""

import gzip
import re

from pyspark.sql import functions as F

from eventdocs.operators import citations, receipts
from eventdocs.operators.constants import with_constants
from eventdocs.operators.badges import badge_elements, badge_layout
from eventdocs.operators.contents import contents_rows, html_items
from eventdocs.schemas import BADGE_EVENT
from eventdocs.sinks import tables
from eventdocs.sources import contents as contents_source
from eventdocs.plans import queries
from eventdocs.sources import feed as feed_source
from eventdocs.sources import roster as roster_source
from test_badges import EVENT
from test_citations import ENTRIES, entry, feed
from test_contents import PAGE

HEADER = "氏名,所属,会員属性,参加費,懇親会参加費,研修会参加費,合計\n"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_rosters_in_csv(spark, tmp_path):
    write(tmp_path / "event_id=1/roster.csv", HEADER + "参加者1,所属1,一般,4000,6000,5000,15000\n参加者2,,学生,2000,0,,2000\n")
    other = HEADER.replace("参加費,懇親会参加費,研修会参加費", "fee,dinner,trip")
    write(tmp_path / "event_id=2/roster.csv", other + '"甲, 乙",所属3,一般,1,2,3,6\n')
    rows = roster_source.read_roster_csv(spark, str(tmp_path)).orderBy("event_id", "entry_no").collect()
    assert [(r["event_id"], r["name"], r["affiliation"], r["fee_workshop"]) for r in rows] == [
        (1, "参加者1", "所属1", 5000), (1, "参加者2", None, None), (2, "甲, 乙", "所属3", 3)
    ]
    headers = roster_source.read_fee_labels(spark, str(tmp_path))
    labels = {r["event_id"]: r["fee_labels"] for r in headers.collect()}
    assert labels == {1: ["参加費", "懇親会参加費", "研修会参加費"], 2: ["fee", "dinner", "trip"]}
    labelled = with_constants(roster_source.read_roster_csv(spark, str(tmp_path)), headers)
    items = receipts.receipt_items(labelled).orderBy("event_id", "entry_no", "slot_no").collect()
    assert [r["fee_label"] for r in items] == [*labels[1], "参加費", *labels[2]]


def test_roster_order_holds_across_file_splits(spark, tmp_path):
    lines = [f"名{i:05},所属,一般,{i},0,0,{i}" for i in range(3000)]
    write(tmp_path / "event_id=1/roster.csv", HEADER + "\n".join(lines) + "\n")
    write(tmp_path / "event_id=2/roster.csv", HEADER + "\n".join(reversed(lines)) + "\n")
    split_size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    open_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        spark.conf.set("spark.sql.files.openCostInBytes", 1_000)
        roster = roster_source.read_roster_csv(spark, str(tmp_path))
        assert roster.select("entry_no", "event_id").distinct().count() == 6000
        placed = badge_layout(roster).withColumn("n", F.col("sheet_no") * 10 + F.col("slot_no"))
        number = F.substring("name", 2, 5).cast("long")
        expected = F.when(F.col("event_id") == 1, number).otherwise(2999 - number)
        assert placed.where(F.col("n") == expected).count() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_size)
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)


def test_rosters_in_parquet(spark, tmp_path, two_attendees):
    path = str(tmp_path / "roster")
    two_attendees.write.partitionBy("event_id").parquet(path)
    assert sorted(roster_source.read_roster_parquet(spark, path).collect()) == sorted(two_attendees.collect())


def test_feeds(spark, tmp_path):
    write(tmp_path / "a.xml", feed(5, *ENTRIES))
    write(tmp_path / "b.xml", feed(2, entry(10), entry(11, authors_ja="一人"), entry(12)))
    entries = feed_source.read_feed_entries(spark, str(tmp_path))
    name = F.regexp_extract("feed_file", r"(\w)\.xml$", 1)
    got = entries.select(name.alias("f"), "ordinal", "doi", "startingPage").orderBy("f", "ordinal").collect()
    expected = [("a", i, f"10.0/{i}") for i in range(5)] + [("b", 0, "10.0/10"), ("b", 1, "10.0/11")]
    assert [tuple(r)[:3] for r in got] == expected
    assert {r["startingPage"] for r in got} == {"001"}
    assert feed_source.read_entries(spark, str(tmp_path)).count() == 8
    cited = citations.with_citation_ja(feed_source.read_entries(spark, str(tmp_path)))
    assert cited.where(F.col("citation").startswith("一人, 表題. ")).count() == 2


def test_citations_read_one_language_of_stored_entries(spark, tmp_path):
    write(tmp_path / "feed/a.xml", feed(5, *ENTRIES))
    feed_source.read_entries(spark, str(tmp_path / "feed")).write.parquet(str(tmp_path / "entries"))
    stored = spark.read.parquet(str(tmp_path / "entries"))
    cited = citations.with_citation_ja(stored).select("citation")
    assert cited.count() == 4
    scan = cited._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert "ja:string" in scan and "en:" not in scan and "doi" not in scan


def test_broken_files_are_reported(spark, tmp_path):
    write(tmp_path / "a.xml", feed(3, entry(0), entry(1).replace("</article_link>", ""), entry(2)))
    write(tmp_path / "b.xml", feed(1, entry(3)))
    entries = feed_source.read_entries(spark, str(tmp_path))
    assert {r["doi"] for r in entries.collect()} == {"10.0/0", "10.0/3", None}
    assert [r["feed_file"][-5:] for r in feed_source.broken_entries(entries).collect()] == ["a.xml"]
    numbered = feed_source.read_feed_entries(spark, str(tmp_path)).collect()
    assert {(r["ordinal"], r["doi"]) for r in numbered} == {(0, "10.0/0"), (2, "10.0/2"), (0, "10.0/3")}
    rejects = {r["feed_file"][-5:]: (r["reason"], r["entries"]) for r in feed_source.read_feed_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {"a.xml": ("not readable as XML", 1)}


def test_large_feeds_are_read_by_several_tasks(spark, tmp_path):
    made = [entry(i).replace("<doi>", "<!-- <entry> old </entry> --><doi>") if i % 5 == 0 else entry(i) for i in range(300)]
    made[7] = made[7].replace("<entry>", '<entry xml:lang="ja"\n id="7">')
    made[9] = made[9].replace("<doi>10.0/9</doi>", "<doi><![CDATA[</entry> 9]]></doi>")
    text = feed(290, *made)
    write(tmp_path / "a.xml", text)
    whole = {r["doi"]: r["ordinal"] for r in feed_source.read_feed_entries(spark, str(tmp_path)).collect()}
    assert whole == {("</entry> 9" if i == 9 else f"10.0/{i}"): i for i in range(290)}
    settings = {"spark.sql.files.maxPartitionBytes": 3000, "spark.sql.files.openCostInBytes": 100}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        pieces = feed_source._pieces(spark, str(tmp_path), [])
        assert pieces.select("_block").distinct().count() > 20
        split = {r["doi"]: r["ordinal"] for r in feed_source.read_feed_entries(spark, str(tmp_path)).collect()}
        assert split == whole and feed_source.read_feed_rejects(spark, str(tmp_path)).collect() == []
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_prefixes_and_feeds_that_break_off(spark, tmp_path):
    plain = feed(3, entry(0), entry(1), entry(2))
    names = {m for m in re.findall(r"</?(\w+)", plain)}
    prefixed = re.sub(r"<(/?)(\w+)", lambda m: f"<{m[1]}a:{m[2]}", plain).replace("xmlns=", "xmlns:a=")
    assert "entry" in names and "<a:entry>" in prefixed
    write(tmp_path / "a.xml", prefixed)
    write(tmp_path / "b.xml", prefixed[: prefixed.rindex("</a:doi>")])
    write(tmp_path / "c.xml", plain[: plain.rindex("<entry>")])
    write(tmp_path / "d.xml", feed(2, entry(0), entry(1), entry(2))[:-40])
    got = feed_source.read_feed_entries(spark, str(tmp_path)).collect()
    assert {(r["feed_file"][-5], r["ordinal"], r["doi"]) for r in got} == {
        (f, i, f"10.0/{i}") for f, n in (("a", 3), ("b", 2), ("c", 2), ("d", 2)) for i in range(n)}
    rejects = {(r["feed_file"][-5], r["reason"], r["entries"]) for r in feed_source.read_feed_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {("b", "breaks off", 1), ("c", "breaks off", 0), ("d", "breaks off", 0)}


def test_feeds_without_a_count_are_reported(spark, tmp_path):
    whole = feed(2, entry(0), entry(1))
    count = whole[whole.index("<totalResults>") : whole.index("</totalResults>") + len("</totalResults>")]
    write(tmp_path / "a.xml", whole)
    write(tmp_path / "b.xml", whole.replace(count, ""))
    write(tmp_path / "c.xml", feed(0))
    write(tmp_path / "d.xml", "")
    entries = feed_source.read_feed_entries(spark, str(tmp_path))
    assert {(r["feed_file"][-5:], r["ordinal"]) for r in entries.collect()} == {("a.xml", 0), ("a.xml", 1)}
    rejects = {(r["feed_file"][-5:], r["reason"], r["entries"]) for r in feed_source.read_feed_rejects(spark, str(tmp_path)).collect()}
    assert {r for r in rejects if r[0] in ("a.xml", "b.xml", "c.xml")} == {("b.xml", "no count of results", 2), ("c.xml", "no entries", 0)}


def test_empty_elements_are_missing_parts(spark, tmp_path):
    broken = entry(1).replace("<volume>", "<volume/><x>").replace("</volume>", "</x>")
    assert broken != entry(1)
    write(tmp_path / "a.xml", feed(3, entry(0), broken, entry(2)))
    entries = feed_source.read_feed_entries(spark, str(tmp_path))
    for cited, lang in ((citations.with_citation_ja, "ja"), (citations.with_citation_en, "en")):
        assert {r["doi"] for r in cited(entries).collect()} == {"10.0/0", "10.0/2"}
        assert [r["doi"] for r in citations.citation_rejects(entries, lang).collect()] == ["10.0/1"]


def test_roster_cells_lose_and_double_nothing(spark, tmp_path):
    lines = ['甲,"所属\n二行",一般,4000.0,"6,000",0,10000', "乙,,一般,免除,免除,免除,", '丙,"a ""b"", c",学生,-5, 7 ,,2', "丁,x,y,1e3,\"1,0\",12x,"]
    write(tmp_path / "event_id=1/b.csv", HEADER + "\n".join(lines[2:]) + "\n")
    write(tmp_path / "event_id=1/a.csv", HEADER + "\n".join(lines[:2]) + "\n")
    write(tmp_path / "event_id=2/a.csv", HEADER)
    rows = roster_source.read_roster_csv(spark, str(tmp_path)).orderBy("event_id", "entry_no").collect()
    got = [(r["name"], r["affiliation"], r["fee_attend"], r["fee_dinner"], r["fee_workshop"]) for r in rows]
    assert got == [("甲", "所属\n二行", 4000, 6000, 0), ("乙", None, None, None, None), ("丙", 'a "b", c', -5, 7, None), ("丁", "x", None, None, None)]
    assert len({r["entry_no"] for r in rows}) == 4
    rejects = {(r["name"], r["column"], r["text"]) for r in roster_source.read_roster_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {("乙", c, "免除") for c in ("fee_attend", "fee_dinner", "fee_workshop")} | {
        ("丁", "fee_attend", "1e3"), ("丁", "fee_dinner", "1,0"), ("丁", "fee_workshop", "12x")}
    labelled = with_constants(roster_source.read_roster_csv(spark, str(tmp_path)), roster_source.read_fee_labels(spark, str(tmp_path)))
    assert receipts.receipt_items(labelled).count() == 4


def test_files_of_an_event_with_other_headers_are_reported(spark, tmp_path):
    row = "甲,x,一般,1,2,3,6\n"
    write(tmp_path / "event_id=1/a.csv", HEADER + row)
    write(tmp_path / "event_id=1/b.csv", HEADER.replace("懇親会", "夕食") + row)
    assert roster_source.read_fee_labels(spark, str(tmp_path)).count() == 0
    rejects = roster_source.read_fee_label_rejects(spark, str(tmp_path)).collect()
    assert [(r["event_id"], len(r["fee_labels"])) for r in rejects] == [(1, 2)]


def test_html_list_is_written_in_order(spark, tmp_path):
    feeds = spark.createDataFrame([(n, feed(5, *ENTRIES)) for n in (2, 1)], "f BIGINT, xml STRING")
    entries = citations.feed_entries(citations.parse_feeds(feeds), ["f"])
    listed = citations.citation_html(entries, ["f"], "en")
    path = tmp_path / "list"
    for part_bytes in (500, 1 << 20):
        tables.write_html_list(listed, str(path), "f", part_bytes=part_bytes)
        text = "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("f=*/part-*")))
        wanted = [r["value"] for r in listed.orderBy("f", "item_index").collect()]
        assert text == "\n".join(wanted) + "\n"


def test_lists_are_cut_by_bytes_and_replaced_one_by_one(spark, tmp_path):
    items = spark.range(0, 5000).select((F.col("id") % 2).alias("f"), F.col("id").alias("item_index"), F.repeat(F.lit("ä"), 50).alias("value"))
    items = items.unionByName(items.where("item_index < 40").withColumn("f", F.lit(7)))
    path = tmp_path / "list"
    tables.write_html_list(items, str(path), "f", part_bytes=50_000)
    sizes = [p.stat().st_size for p in path.glob("f=*/part-*")]
    assert sum(sizes) == 5040 * 101 and max(sizes) < 70_000 and 10 <= len(sizes) <= 14
    kept = (path / "f=0").stat().st_mtime_ns, sorted(p.name for p in (path / "f=0").iterdir())
    tables.write_html_list(items.where("f = 1 AND item_index < 600"), str(path), "f", part_bytes=50_000)
    assert sum(p.stat().st_size for p in path.glob("f=1/part-*")) == 300 * 101
    assert kept == ((path / "f=0").stat().st_mtime_ns, sorted(p.name for p in (path / "f=0").iterdir()))


def test_events_are_replaced_one_by_one(spark, tmp_path, make_roster):
    path = str(tmp_path / "receipts")
    items = receipts.receipt_items(make_roster({1: 12, 2: 3, 3: 4}))
    tables.write_by_event(items.where("event_id < 3"), path, tables.RECEIPT_ORDER)
    for _ in range(2):
        tables.write_by_event(items.where("event_id > 1"), path, tables.RECEIPT_ORDER)
    back = spark.read.schema(items.schema).parquet(path).select(items.columns)
    assert sorted(back.collect(), key=str) == sorted(items.collect(), key=str)


def test_contents_pages(spark, tmp_path):
    write(tmp_path / "in/1.html", PAGE)
    write(tmp_path / "in/2.html", '<h1 class="section-level1">\n a,"b"\nc </h1>')
    pages = contents_source.read_contents_pages(spark, str(tmp_path / "in"))
    rows = contents_rows(html_items(pages, ["url"]), ["url"])
    assert {r["count"] for r in rows.groupBy("url").count().collect()} == {5, 1}
    tables.write_contents_rows(rows, str(tmp_path / "out"), "url")
    columns = ["url", "pos", "section", "title", "author", "add_info"]
    written = rows.select(columns)
    back = spark.read.schema(written.schema).options(multiLine="true", **tables.CONTENTS_CSV).csv(str(tmp_path / "out"))
    assert sorted(back.collect(), key=str) == sorted(written.collect(), key=str)


def test_layouts_by_event(spark, tmp_path, make_roster):
    roster = make_roster({1: 12, 2: 3})
    events = spark.createDataFrame([EVENT, (2, *EVENT[1:])], BADGE_EVENT)
    drawn = badge_elements(badge_layout(roster), events)
    path = tmp_path / "badges"
    tables.write_by_event(drawn, str(path), tables.BADGE_ORDER)
    assert {p.name for p in path.glob("event_id=*")} == {"event_id=1", "event_id=2"}
    back = spark.read.parquet(str(path)).select(drawn.columns)
    assert sorted(back.collect(), key=str) == sorted(drawn.collect(), key=str)
    items = receipts.receipt_items(roster)
    tables.write_by_event(items, str(tmp_path / "receipts"), tables.RECEIPT_ORDER)
    assert spark.read.parquet(str(tmp_path / "receipts")).count() == items.count()


def rejects_of(spark, path, **how):
    return {(r["name"], r["column"], r["text"], r["reason"]) for r in roster_source.read_roster_rejects(spark, str(path), **how).collect()}


def names_of(spark, path, **how):
    return [r["name"] for r in roster_source.read_roster_csv(spark, str(path), **how).orderBy("event_id", "entry_no").collect()]


def test_a_quote_that_is_never_closed_costs_its_own_line_only(spark, tmp_path):
    lines = ["A,x,m,1,2,3,6", 'B,"open,m,1,2,3,6', 'C,"y, z",m,1,2,3,6', "D,,m,0,0,0,0", "", "E,x,m,1,1,1,3"]
    write(tmp_path / "first/event_id=1/a.csv", HEADER + "\n".join(lines) + "\n")
    assert names_of(spark, tmp_path / "first") == ["A", "C", "D", "E"]
    assert rejects_of(spark, tmp_path / "first") == {("B", None, lines[1], "quote not closed")}
    # In the last cell the number of cells is right, and the line has told all.
    lines[1] = 'B,x,m,1,2,3,"6'
    for folder, own in (("last", lines), ("plain", [x.replace('"y, z"', "y") for x in lines])):
        write(tmp_path / folder / "event_id=1/a.csv", HEADER + "\r\n".join(own) + "\r\n")
        rows = roster_source.read_roster_csv(spark, str(tmp_path / folder)).orderBy("entry_no").collect()
        assert [(r["name"], r["total"]) for r in rows] == [("A", 6), ("B", 6), ("C", 6), ("D", 0), ("E", 3)]
        assert rejects_of(spark, tmp_path / folder) == set()


def test_rows_with_another_number_of_cells_are_reported_and_left_out(spark, tmp_path):
    lines = ["A,x,m,1000", "B,x, y,m,1000,2,3,6", 'C,"x, y",m,1,2,3,6', 'D,"x\ny",m,1']
    write(tmp_path / "event_id=1/a.csv", HEADER + "\n".join(lines) + "\n")
    assert names_of(spark, tmp_path) == ["C"]
    wrong = "wrong number of cells"
    found = rejects_of(spark, tmp_path)
    assert {r[1:] for r in found if r[0] in ("A", "B")} == {(None, lines[0], wrong), (None, lines[1], wrong)}
    assert "".join(sorted(r[2] for r in found if r[0] not in ("A", "B"))) == 'D,"xy",m,1'


def test_further_columns_are_no_fault(spark, tmp_path):
    more = HEADER.replace("\n", ",備考,連絡先\n")
    write(tmp_path / "event_id=1/a.csv", more + "A,x,m,1,2,3,6,n,t\nB,x,m,1,2,3,6\nC,x,m,1,2,3,6,,\n")
    write(tmp_path / "event_id=2/a.csv", "氏名,所属\nD,x\n")
    assert names_of(spark, tmp_path) == ["A", "C"]
    assert {(r[0], r[3]) for r in rejects_of(spark, tmp_path)} == {(n, "wrong number of cells") for n in ("B", "D", "氏名")}
    labels = roster_source.read_fee_labels(spark, str(tmp_path)).where("event_id = 1").collect()
    assert labels[0]["fee_labels"] == ["参加費", "懇親会参加費", "研修会参加費"]


def test_long_cells_are_reported(spark, tmp_path):
    write(tmp_path / "event_id=1/a.csv", HEADER + f"A,{'x' * 30},m,1,2,3,6\nB,x,m,1,2,3,6\n")
    assert rejects_of(spark, tmp_path, longest=20) == {("A", "affiliation", "x" * 30, "too long")}
    assert names_of(spark, tmp_path) == ["A", "B"] and rejects_of(spark, tmp_path) == set()


def test_rosters_in_another_encoding(spark, tmp_path):
    path = tmp_path / "event_id=1/a.csv"
    path.parent.mkdir(parents=True)
    path.write_bytes((HEADER + "髙橋①,ソ表ー大学,一般,1,2,3,6\n" + '"山田\n太郎",能,一般,"4,000",2,3,6\n').encode("cp932"))
    rows = roster_source.read_roster_csv(spark, str(tmp_path), encoding="windows-31j").orderBy("entry_no").collect()
    assert [(r["name"], r["affiliation"], r["fee_attend"]) for r in rows] == [("髙橋①", "ソ表ー大学", 1), ("山田\n太郎", "能", 4000)]
    labels = roster_source.read_fee_labels(spark, str(tmp_path), encoding="windows-31j").collect()
    assert labels[0]["fee_labels"] == ["参加費", "懇親会参加費", "研修会参加費"]


def files_of(df):
    return {(r["event_id"], r["file"].rpartition("/")[2], r["reason"], r["rows"]) for r in df.collect()}


def test_damaged_parquet_files_are_skipped_and_reported(spark, tmp_path, make_roster):
    path = tmp_path / "rosters"
    make_roster({1: 3000, 2: 5}).coalesce(1).write.option("parquet.block.size", 4096).option("parquet.page.row.count.limit", 200).partitionBy("event_id").parquet(str(path))
    (path / "event_id=2/garbage.parquet").write_text("no table at all")
    (path / "event_id=3").mkdir()
    (path / "event_id=3/none.parquet").write_bytes(b"")
    whole = next((path / "event_id=1").glob("part-*.parquet"))
    content = whole.read_bytes()
    (path / "event_id=1/cut.parquet").write_bytes(content[: len(content) // 2])
    assert roster_source.read_roster_parquet(spark, str(path)).count() == 3005
    found = files_of(roster_source.read_roster_parquet_rejects(spark, str(path)))
    assert found == {(1, "cut.parquet", "not readable", 0), (2, "garbage.parquet", "not readable", 0)}
    # Damage within the pages: the footer still promises all rows.
    spoilt = bytearray(content)
    spoilt[len(content) // 2 : len(content) // 2 + 4000] = bytes(4000)
    (path / "event_id=1/spoilt.parquet").write_bytes(bytes(spoilt))
    (reason, rows), = {r[2:] for r in files_of(roster_source.read_roster_parquet_rejects(spark, str(path))) if r[1] == "spoilt.parquet"}
    assert reason == "breaks off" and rows < 3000
    assert len(roster_source.read_roster_parquet(spark, str(path)).collect()) == 3005 + rows


def test_damaged_packed_files_are_read_to_the_damage_and_reported(spark, tmp_path):
    lines = "".join(f"名{i},所属{i * 7919 % 1000},m,{i},2,3,6\n" for i in range(20_000))
    packed = gzip.compress((HEADER + lines).encode())
    (tmp_path / "event_id=1").mkdir()
    (tmp_path / "event_id=1/whole.csv.gz").write_bytes(packed)
    (tmp_path / "event_id=1/two.csv.gz").write_bytes(gzip.compress((HEADER + "A,x,m,1,2,3,6\n").encode()) + gzip.compress("B,x,m,1,2,3,6\n".encode()))
    write(tmp_path / "event_id=2/plain.csv", HEADER + "A,x,m,1,2,3,6\n")
    write(tmp_path / "event_id=2/void.csv", "")
    assert files_of(roster_source.read_roster_file_rejects(spark, str(tmp_path))) == set()
    assert roster_source.read_roster_csv(spark, str(tmp_path)).count() == 20_003
    (tmp_path / "event_id=3").mkdir()
    (tmp_path / "event_id=3/torn.csv.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "event_id=3/other.csv.gz").write_bytes(b"no gzip")
    found = {r[1]: r[2:] for r in files_of(roster_source.read_roster_file_rejects(spark, str(tmp_path)))}
    assert set(found) == {"torn.csv.gz", "other.csv.gz"} and found["other.csv.gz"] == ("breaks off", 0)
    assert found["torn.csv.gz"][0] == "breaks off" and found["torn.csv.gz"][1] < 20_000
    names = {r["name"] for r in roster_source.read_roster_csv(spark, str(tmp_path)).select("name").collect()}
    assert {"A", "B", "名0", "名19999"} <= names


def test_lines_of_an_open_quote_do_not_each_carry_the_rest_of_the_file(spark, tmp_path):
    lines = [f"名{i:05},所属,一般,{i},0,0,{i}" for i in range(2000)]
    lines[3] = '"' + lines[3]
    write(tmp_path / "event_id=1/roster.csv", HEADER + "\n".join(lines) + "\n")
    read = roster_source._lines(spark, str(tmp_path), "UTF-8")
    assert read.count() == 2001
    plan = read._jdf.queryExecution().executedPlan().toString()
    scanned = set(re.findall(r"FileScan csv \[(.*?)\]", plan)[0].split(",")) - {"event_id"}
    generated = re.findall(r"Generate posexplode\(.*?\), \[(.*?)\]", plan)[0].split(", ")
    assert not {c for c in scanned & set(generated) if not c.startswith("event_id")}
    names = {r["name"] for r in roster_source.read_roster_csv(spark, str(tmp_path)).collect()}
    assert names == {f"名{i:05}" for i in range(2000) if i != 3}


def test_lists_of_very_many_parts_have_larger_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MOST_PARTS", 8)
    items = spark.range(20_000).select((F.col("id") % 2).alias("f"), F.col("id").alias("item_index"), F.format_string("item %06d", "id").alias("value"))
    tables.write_html_list(items, str(tmp_path), "f", part_bytes=1000)
    files = sorted(tmp_path.glob("f=0/*.txt"))
    assert len(list(tmp_path.glob("f=*/*.txt"))) <= 10 and len(files) > 2
    assert "".join(f.read_text() for f in files) == "".join(f"item {i:06}\n" for i in range(0, 20_000, 2))


def test_feed_rejects_read_pieces_once_and_patterns_only_where_a_word_occurs(spark, tmp_path, monkeypatch):
    entries = "<a:entry><number>1</number></a:entry><!-- <entry> --><entry x='1'><number>2</number></entry><entry><number>3<"
    (tmp_path / "feed.xml").write_text(f"<f:feed><totalResults>9</totalResults>{entries}", encoding="utf-8")
    made, pieces = [], feed_source._pieces
    monkeypatch.setattr(feed_source, "_pieces", lambda *how: made.append(pieces(*how)) or made[-1])
    rejects = feed_source.read_feed_rejects(spark, str(tmp_path)).collect()
    assert [(r["reason"], r["entries"]) for r in rejects] == [("breaks off", 1)]
    assert len(made) == 1
    found = feed_source.read_feed_entries(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["number"]) for r in found] == [(0, "1"), (1, "2")]


def test_roster_files_are_written_by_several_tasks_in_order(spark):
    path = queries._roster_files(spark, "/root/testdata/sf0.01")
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').select("event_id", F.input_file_name().alias("file"), "name")
    rows = rows.groupBy("event_id", "file").agg(F.min("name").alias("first"), F.max("name").alias("last")).collect()
    assert len({re.search(r"part-(\d+)", r["file"])[1] for r in rows}) > 1
    for event in {r["event_id"] for r in rows}:
        files = sorted((r["file"], r["first"], r["last"]) for r in rows if r["event_id"] == event)
        assert all(one[2] < other[1] for one, other in zip(files, files[1:]))
