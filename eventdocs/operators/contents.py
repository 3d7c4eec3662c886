"""Item rows from contents pages: section headings and the articles listed under them.

The pages are ordinary HTML, not XML, so a Python tokenizer reads them, a page at a time in Arrow batches. It
only finds items and their texts; the texts are cleaned by built-in functions afterwards.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventdocs.functions.text import clean_contents_text, section_text
from eventdocs.schemas import CONTENTS_ITEM

# The tokenizer travels with the job, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# HTML elements without an end tag, those that keep their white space, and those whose text is not
# part of the text around them.
_VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr".split()) | {
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer"
}
_KEEPS_SPACE = frozenset({"pre", "textarea"})
_NO_TEXT = frozenset({"script", "style", "template", "rt", "rp"})
_ASCII_SPACE = " \n\t\f\r"
_FIELDS = ("title", "author", "add_info")
#: Characters of pages whose items are handed on together, so that a task's memory does not grow with its pages.
_TOGETHER = 1 << 20


@dataclass(frozen=True)
class ItemRule:
    """Which elements are items and fields: ``.class``, ``#id`` or a tag name each."""

    heading: str = ".section-level1"
    wrapper: str = "#search-resultslist-wrap"
    item: str = "li"
    title: str = ".searchlist-title"
    author: str = ".searchlist-authortags"
    add_info: str = ".searchlist-additional-info"


def _selects(selector: str, tag: str, attrs: dict[str, str]) -> bool:
    if selector.startswith("."):
        return selector[1:] in attrs.get("class", "").split()
    if selector.startswith("#"):
        return attrs.get("id") == selector[1:]
    return tag == selector


def _character(code: int) -> str:
    """Character of a numeric reference; pages that mean Windows-1252 by 128 to 159 are understood."""
    try:
        return bytes([code]).decode("windows-1252")
    except ValueError:
        is_character = code < 0xD800 or 0xE000 <= code < 0x110000
        return chr(code) if is_character else "\N{REPLACEMENT CHARACTER}"


@dataclass
class _Item:
    kind: str
    text: list[str] = field(default_factory=list)
    fields: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class _Open:
    """An open element, with the item it is and the item fields it fills."""

    tag: str
    item: _Item | None
    fills: list[list[str]]
    wraps: bool

    @property
    def takes_text(self) -> bool:
        return self.item is not None or bool(self.fills)


class _ItemReader(HTMLParser):
    """Collects the items of one page. End tags close the nearest open element of their name, or nothing."""

    def __init__(self, rule: ItemRule):
        super().__init__(convert_charrefs=False)
        self.rule = rule
        self.items: list[_Item] = []
        self.open: list[_Open] = []
        self.taking: list[_Open] = []
        self.wrappers = 0
        self.depth_of: dict[str, int] = {}
        self.node: list[str] = []

    def inside(self, tags: frozenset[str]) -> bool:
        return any(self.depth_of.get(tag) for tag in tags)

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag in _VOID:
            return
        given = {name: value or "" for name, value in attrs}
        fills = []
        for outer in self.taking:
            for name in _FIELDS if outer.item is not None else ():
                if name not in outer.item.fields and _selects(getattr(self.rule, name), tag, given):
                    outer.item.fields[name] = []
                    fills.append(outer.item.fields[name])
        item = None
        if _selects(self.rule.heading, tag, given):
            item = _Item("heading")
        elif self.wrappers and _selects(self.rule.item, tag, given):
            item = _Item("item")
        if item is not None:
            self.items.append(item)
        opened = _Open(tag, item, fills, _selects(self.rule.wrapper, tag, given))
        self.open.append(opened)
        if opened.takes_text:
            self.taking.append(opened)
        self.wrappers += opened.wraps
        self.depth_of[tag] = self.depth_of.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.end_node()
        while self.depth_of.get(tag):
            closed = self.open.pop()
            if closed.takes_text:
                self.taking.pop()
            self.wrappers -= closed.wraps
            self.depth_of[closed.tag] -= 1
            if closed.tag == tag:
                return

    def handle_data(self, data):
        self.node.append(data)

    def handle_entityref(self, name):
        self.node.append(html5.get(f"{name};", f"&{name}"))

    def handle_charref(self, name):
        digits, base = (name[1:], 16) if name[0] in "xX" else (name, 10)
        self.node.append(_character(int(digits.lstrip("0")[:9] or "0", base)))

    def handle_comment(self, data):
        self.end_node()

    def handle_pi(self, data):
        self.end_node()

    def unknown_decl(self, data):
        self.end_node()
        if data.startswith("CDATA["):
            self.node.append(data[len("CDATA[") :])
            self.end_node()

    def end_node(self):
        """Hand a finished text node to the items and fields it is inside of."""
        text, self.node = "".join(self.node), []
        if not text or not self.taking or self.inside(_NO_TEXT):
            return
        if not text.strip(_ASCII_SPACE) and not self.inside(_KEEPS_SPACE):
            text = "\n" if "\n" in text else " "
        stripped = text.strip()
        for outer in self.taking:
            if outer.item is not None:
                outer.item.text.append(text)
            for parts in outer.fills:
                parts.append(stripped)

    def read(self, html: str) -> list[_Item]:
        try:
            self.feed(html)
            self.close()
            self.end_node()
        except AssertionError:
            self.items.append(_Item("unreadable"))
        return self.items


def html_items(pages: DataFrame, keep: Sequence[str], rule: ItemRule = ItemRule(), html: str = "html") -> DataFrame:
    """Items of every page in document order, with the whole text and the first match of each field.

    A page with markup that the tokenizer gives up on has the items before it, and a last one of kind
    ``unreadable``.
    """
    keep = list(keep)
    schema = T.StructType([*pages.select(*keep).schema, T.StructField("pos", T.LongType()), *T._parse_datatype_string(CONTENTS_ITEM)])
    item_type = pa.struct([(name, pa.string()) for name in schema.names[len(keep) + 1 :]])

    def rows(batch: pa.RecordBatch, owner: list[int], pos: list[int], items: list[tuple]) -> pa.RecordBatch:
        own = batch.select(keep).take(pa.array(owner, pa.int64())).columns
        texts = pa.array([dict(zip(schema.names[len(keep) + 1 :], i)) for i in items], item_type).flatten()
        return pa.RecordBatch.from_arrays([*own, pa.array(pos, pa.int64()), *texts], names=schema.names)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, pos, items, read = [], [], [], 0
            for at, page in enumerate(batch.column(html)):
                found = _ItemReader(rule).read(text) if (text := page.as_py()) else []
                for i, item in enumerate(found):
                    fields = ("".join(item.fields[name]) if name in item.fields else None for name in _FIELDS)
                    items.append((item.kind, "".join(item.text), *fields))
                    owner.append(at)
                    pos.append(i)
                read += len(text or "")
                if read > _TOGETHER:
                    yield rows(batch, owner, pos, items)
                    owner, pos, items, read = [], [], [], 0
            yield rows(batch, owner, pos, items)

    asked = dict.fromkeys([*keep, html])
    return pages.select(*asked).mapInArrow(extract, schema)


def contents_rows(items: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Section, title, author and page information of every item; null where an item has no such part."""
    cleaned = [clean_contents_text(F.col(name)).alias(name) for name in _FIELDS]
    return items.select(*keep, "pos", "kind", section_text(F.col("text")).alias("section"), *cleaned)
