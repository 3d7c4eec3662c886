import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from eventdocs.operators import contents
from eventdocs.operators.contents import ItemRule, contents_rows, html_items


def items(spark, html, rule=ItemRule()):
    df = spark.createDataFrame([(1, html)], "page_id BIGINT, html STRING")
    return html_items(df, ["page_id"], rule).orderBy("pos")


def rows(spark, html, rule=ItemRule()):
    return contents_rows(items(spark, html, rule), ["page_id"]).orderBy("pos").collect()


PAGE = """<html><body><li>outside</li><h2 class="a section-level1">原著論文</h2>
<div id="search-resultslist-wrap"><ul>
 <li>
   <div class="searchlist-title">　 題 <b> 太字 </b>
	続き +x </div>
   <div class=searchlist-authortags>甲 &amp; 乙<br/>丙</div>
   <p class="x searchlist-additional-info">p.&#160;1&ndash;2<!-- no --></p>
   <div class="searchlist-title">second</div><script>var a = "</li>";</script></li>
 <li>short</li>
 <li><span>twenty-one characters</span></li>
</ul><h2 class="section-level1">資料</h2></div></body></html>"""


def test_items_in_document_order(spark):
    got = rows(spark, PAGE)
    assert [r["kind"] for r in got] == ["heading", "item", "item", "item", "heading"]
    assert [r["section"] for r in got] == ["原著論文", "", "short", "", "資料"]
    assert got[1]["title"] == "題太字続き x"
    assert got[1]["author"] == "甲 & 乙丙"
    assert got[1]["add_info"] == "p. 1–2"
    assert [got[2][name] for name in ("title", "author", "add_info")] == [None, None, None]


@pytest.mark.parametrize("text, section", [("x" * 20, "x" * 20), ("x" * 21, ""), ("あ" * 20, "あ" * 20), (" a ", " a ")])
def test_section_gate(spark, text, section):
    assert rows(spark, f'<h1 class="section-level1">{text}</h1>')[0]["section"] == section


def test_white_space_nodes_shrink(spark):
    html = '<div class="section-level1">\n      <b>ab</b>      <i>cd</i><pre>      </pre></div>'
    assert items(spark, html).first()["text"] == "\nab cd      "


def test_unclosed_items_nest(spark):
    html = '<ul id="search-resultslist-wrap"><li>a<li>b</ul><li>c'
    got = items(spark, html).collect()
    assert [r["text"] for r in got] == ["ab", "b"]


def test_end_tags_without_start_are_ignored(spark):
    html = '<ol id="search-resultslist-wrap"></li></p><li>a</b><br>b</li></ol>'
    assert [r["text"] for r in items(spark, html).collect()] == ["ab"]


def test_field_belongs_to_every_item_around_it(spark):
    html = (
        '<div id="search-resultslist-wrap"><li>o<ul><li>i<a class="searchlist-title">t</a></li></ul>'
        '<a class="searchlist-title">u</a></li></div>'
    )
    got = items(spark, html).collect()
    assert [(r["text"], r["title"]) for r in got] == [("oitu", "t"), ("it", "t")]


def test_an_item_is_not_its_own_field(spark):
    html = '<div id="search-resultslist-wrap"><li class="searchlist-title">a</li></div>'
    assert items(spark, html).first()["title"] is None


def test_entities(spark):
    html = '<h1 class="section-level1">&lt;&unknown;&#x41;&#66;&#147;&#129;&#12354;&#55296;&#1114112;&amp&</h1>'
    assert items(spark, html).first()["text"] == "<&unknownAB“\x81あ\ufffd\ufffd&&"


def test_references_of_any_length(spark):
    html = f'<h1 class="section-level1">&#{"0" * 6000}65;&#{"9" * 6000};&#x{"f" * 99};&#00065;</h1>'
    assert items(spark, html).first()["text"] == "A\ufffd\ufffdA"


def test_unreadable_markup_is_reported(spark):
    def give_up(reader, html):
        raise AssertionError("markup")

    from eventdocs.operators import contents

    reader = contents._ItemReader(ItemRule())
    reader.handle_comment = lambda data: give_up(reader, data)
    got = reader.read('<h1 class="section-level1">a</h1><!-- x --><h1 class="section-level1">b</h1>')
    assert [item.kind for item in got] == ["heading", "unreadable"]
    mixed = '<h1 class="section-level1">a<![if x]>b<![endif]>c<![foo]>d</h1>'
    assert items(spark, mixed).first()["kind"] == "heading"


def test_text_that_is_not_part_of_an_item(spark):
    html = '<h1 class="section-level1"><ruby>漢<rp>(</rp><rt>かん</rt></ruby><style>p{}</style><?x?>字</h1>'
    assert items(spark, html).first()["text"] == "漢字"


def test_other_rule_and_empty_pages(spark):
    rule = ItemRule(heading="h1", wrapper="nav", item="li", title="a")
    got = rows(spark, "<nav><li><a>x</a></li></nav><li>no</li><h1>y</h1>", rule)
    assert [(r["kind"], r["section"], r["title"]) for r in got] == [("item", "x", "x"), ("heading", "y", None)]
    assert rows(spark, "") == [] and rows(spark, None) == []


def test_workers_need_no_package(tmp_path):
    from eventdocs.operators import contents

    read = cloudpickle.dumps(contents._ItemReader)
    check = "import pickle, sys; pickle.load(sys.stdin.buffer); assert 'eventdocs' not in sys.modules"
    done = subprocess.run([sys.executable, "-c", check], input=read, cwd=tmp_path, capture_output=True)
    assert done.returncode == 0, done.stderr


def test_items_are_handed_on_a_few_pages_at_a_time(spark, monkeypatch):
    sizes, made = [], pa.RecordBatch.from_arrays

    class Batches:
        @staticmethod
        def from_arrays(arrays, names):
            sizes.append(len(arrays[0]))
            return made(arrays, names=names)

    pages = spark.createDataFrame([(i, PAGE * (i % 3)) for i in range(60)], "page_id long, html string")
    seen = {}
    with monkeypatch.context() as patch:
        patch.setattr(type(pages), "mapInArrow", lambda self, f, schema: seen.setdefault("f", f) and self)
        contents.html_items(pages, ["page_id"])
    batch = made([pa.array(range(60)), pa.array([PAGE * (i % 3) for i in range(60)])], names=["page_id", "html"])
    whole = pa.Table.from_batches(seen["f"](iter([batch]))).to_pylist()
    monkeypatch.setattr(contents, "_TOGETHER", 2 * len(PAGE))
    monkeypatch.setattr(contents.pa, "RecordBatch", Batches)
    few = pa.Table.from_batches(seen["f"](iter([batch]))).to_pylist()
    assert few == whole and len({r["page_id"] for r in few}) == 40
    assert len(sizes) > 20 and sum(sizes) == len(few)
