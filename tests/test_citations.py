import pytest

from eventdocs.operators import citations

ENTRY = """<entry>
 <article_title><en>{en}</en>
  <ja>{ja}</ja></article_title>
 <article_link><en>http://e/{n}</en><ja>http://j/{n}</ja></article_link>
 <author><en>{authors_en}</en><ja>{authors_ja}</ja></author>
 <prism/><a/><b/><c/>
 <volume>41</volume><number>2</number><startingPage>001</startingPage><endingPage>{last}</endingPage>
 <pubyear>2024</pubyear><doi>10.0/{n}</doi></entry>"""


def entry(n, en="An  English\ntitle", ja="表題", authors_en="", authors_ja="", last="010"):
    def names(text):
        return "".join(f"\n   <name>{name}</name>" for name in text.split("|") if name)

    return ENTRY.format(n=n, en=en, ja=ja, authors_en=names(authors_en), authors_ja=names(authors_ja), last=last)


def feed(total, *entries):
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom">'
    return f"{head}<title>t</title><totalResults>{total}</totalResults>{''.join(entries)}</feed>"


ENTRIES = [
    entry(0, authors_en="Ann  B|C D", authors_ja="著者  一|著者二"),
    entry(1, ja=""),
    entry(2, en="", ja="題  名\nその二"),
    entry(3, authors_ja="一人"),
    entry(4, ja="最後 &amp; &lt;b&gt;"),
]


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(1, feed(5, *ENTRIES)), (2, feed(1, *ENTRIES[:2])), (3, feed(9, ENTRIES[0]))]
    feeds = spark.createDataFrame(rows, "f BIGINT, xml STRING")
    return citations.feed_entries(citations.parse_feeds(feeds), ["f"])


def test_count_of_results_limits_the_entries(entries):
    counts = {r["f"]: r["count"] for r in entries.groupBy("f").count().collect()}
    assert counts == {1: 5, 2: 1, 3: 1}


def test_texts_stay_as_they_are(entries):
    first = entries.where("f = 1 and ordinal = 0").first()
    assert first["startingPage"] == "001"
    assert first["article_title"]["en"] == "An  English\ntitle"
    assert first["author"]["ja"]["name"] == ["著者  一", "著者二"]


def test_japanese(entries):
    rows = citations.with_citation_ja(entries.where("f = 1")).orderBy("ordinal").collect()
    tail = ", 2024, 41巻, 2号, p.001-010"
    assert [r["citation"] for r in rows] == [
        "著者一, 著者二, 表題. 植生学会誌" + tail,
        "題名その二. 植生学会誌" + tail,
        "一人, 表題. 植生学会誌" + tail,
        "最後 & <b>. 植生学会誌" + tail,
    ]
    assert [r["ordinal"] for r in rows] == [0, 2, 3, 4]


def test_english(entries):
    rows = citations.with_citation_en(entries.where("f = 1")).orderBy("ordinal").collect()
    tail = ", 2024, Volume41, Issue 2, Pages001-010"
    assert rows[0]["citation"] == "AnnB, C D, AnEnglishtitle Vegetation Science" + tail
    assert rows[1]["citation"] == ", AnEnglishtitle Vegetation Science" + tail
    assert [r["ordinal"] for r in rows] == [0, 1, 3, 4]


def test_list_items(entries):
    ja = citations.citation_html(entries.where("f = 1"), ["f"], "ja").orderBy("item_index").collect()
    en = citations.citation_html(entries.where("f = 1"), ["f"], "en").orderBy("item_index").collect()
    assert [r["item_index"] for r in ja] == [0, 2, 3, 4]
    assert [r["item_index"] for r in en] == [9, 10, 12, 13]
    assert ja[3]["value"].split("\n") == [
        "4",
        '<li style="margin-left: 40px; padding-bottom: 15px;">',
        ' <a href="http://j/4">',
        "     最後 & <b>. 植生学会誌, 2024, 41巻, 2号, p.001-010",
        " </a>",
        "</li>",
    ]


def test_unreadable_feeds_are_reported(spark):
    cut = feed(1, ENTRIES[0])[:-40]
    rows = [(1, feed(1, ENTRIES[0])), (2, cut), (3, None), (4, feed(0)), (5, feed("many", ENTRIES[0]))]
    parsed = citations.parse_feeds(spark.createDataFrame(rows, "f BIGINT, xml STRING"))
    assert {r["f"] for r in citations.feed_rejects(parsed).collect()} == {2, 3, 4, 5}
    assert {r["f"] for r in citations.feed_entries(parsed, ["f"]).collect()} == {1}


def test_incomplete_entries_are_rejected(spark):
    broken = entry(7).replace("<volume>41</volume>", "")
    feeds = spark.createDataFrame([(1, feed(2, broken, entry(8)))], "f BIGINT, xml STRING")
    found = citations.feed_entries(citations.parse_feeds(feeds), ["f"])
    assert [r["doi"] for r in citations.with_citation_ja(found).collect()] == ["10.0/8"]
    assert [r["doi"] for r in citations.citation_rejects(found, "ja").collect()] == ["10.0/7"]
