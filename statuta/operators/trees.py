"""Pages as trees of tags: a small parser in tasks, selectors as column expressions.

tree(html) reads a page once and returns a struct of
  text   all strings of the page in order; STRING ends each string, BLOCK each element that is a block of its own;
  nodes  one element a tag, in page order: its number (at), the parent's number (-1: none), the number of the last element
         inside (last), tag, classes, attributes by name (attrs), and where its strings and its markup begin and end;
  error  what the parser could not read, else null; such a page has no nodes.
Elements need not be closed in the page: an end tag closes the nearest open element of its name and all that is open inside it;
an end tag of an element that isn't open is none. Attributes come in any order; of one name the last counts. Strings of scripts,
styles and templates and comments are no text. A null page is an empty one. What is made of a page is as large as the page.

planted(pages, html) adds the tree to a table of pages; pages are read and handed on in parts of at most PART characters, so what a
task's worker holds follows neither the rows of a batch nor the elements of its pages.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRING, BLOCK = "\x1f", "\x1e"
#: Elements without content or end tag; those whose end breaks a line; those whose strings are no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("br p div tr li table h1 h2 h3 h4 h5 h6".split())
SILENT = frozenset("script style template".split())
#: Characters of pages that a task makes trees of at a time (or one page).
PART = 1 << 18
#: Tags without attributes; most are.
_OPENS, _CLOSES = re.compile(r"<([a-z][a-z0-9]*)>"), re.compile(r"</([a-z][a-z0-9]*)>")

_NODE = pa.struct([
    ("at", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text_from", pa.int32()), ("text_to", pa.int32()), ("html_from", pa.int32()), ("html_to", pa.int32()),
])
TREE = """text string, nodes array<struct<at:int,parent:int,last:int,tag:string,classes:array<string>,attrs:map<string,string>,text_from:int,text_to:int,html_from:int,html_to:int>>, error string"""


_FIELDS = [f.name for f in _NODE][1:]
_LAST, _TAG, _TEXT_TO, _HTML_TO = (_FIELDS.index(f) for f in ("last", "tag", "text_to", "html_to"))
TYPE = f"struct<{TREE.replace('text string', 'text:string').replace('nodes array', 'nodes:array').replace('error string', 'error:string')}>"


class _Tree(HTMLParser):
    """Elements in page order (lists of _FIELDS), with offsets into the page and into its text."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.strings: list[str] = []
        self.size = self.silent = self.begun = self.place = 0
        self.open: list[int] = []
        self.names: dict[str, int] = {}
        self.feed(page)
        self.begun = len(page) - len(self.rawdata)  # what is left is read from its own start
        self.close()
        while self.open:
            self.ended(len(page))

    def updatepos(self, i: int, j: int) -> int:
        self.place = j
        return j

    def here(self) -> int:
        return self.begun + self.place

    def parse_starttag(self, i: int) -> int:
        m = _OPENS.match(self.rawdata, i)
        if m is None or m[1] in self.CDATA_CONTENT_ELEMENTS:
            return super().parse_starttag(i)
        self.lasttag = m[1]
        self.started(m[1], (), self.begun + m.end())
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = _CLOSES.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()

    def add(self, text: str) -> None:
        self.strings.append(text)
        self.size += len(text)

    def started(self, tag: str, attrs: tuple | list, inside: int) -> None:
        a = {k: v or "" for k, v in attrs} if attrs else {}
        open_ = self.open
        open_.append(len(self.nodes))
        self.nodes.append([open_[-2] if len(open_) > 1 else -1, 0, tag, a.get("class", "").split() if a else [], list(a.items()), self.size, 0, inside, 0])
        self.names[tag] = self.names.get(tag, 0) + 1
        self.silent += tag in SILENT
        if tag in VOID:
            self.ended(inside)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.started(tag, attrs, self.here() + len(self.get_starttag_text() or ""))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.ended(self.here() + len(self.get_starttag_text() or ""))

    def ended(self, at: int) -> None:
        n = self.nodes[self.open.pop()]
        n[_LAST], n[_TEXT_TO], n[_HTML_TO] = len(self.nodes) - 1, self.size, at
        tag = n[_TAG]
        self.names[tag] -= 1
        self.silent -= tag in SILENT
        if tag in BLOCKS and not self.silent:
            self.add(BLOCK)

    def handle_endtag(self, tag: str) -> None:
        if self.names.get(tag):
            at = self.here()
            while self.nodes[self.open[-1]][_TAG] != tag:
                self.ended(at)
            self.ended(at)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.add(data.replace(STRING, " ").replace(BLOCK, " ") + STRING)


def _read(page: str | None) -> tuple[str, list[list], str | None]:
    try:
        t = _Tree(page or "")
    except (AssertionError, ValueError) as e:  # what the parser says of declarations that it can't read
        return "", [], f"{type(e).__name__}: {e}"
    return "".join(t.strings), t.nodes, None


def parsed(page: str | None) -> dict:
    text, nodes, error = _read(page)
    return {"text": text, "nodes": [{"at": at} | dict(zip(_FIELDS, n)) for at, n in enumerate(nodes)], "error": error}


def _offsets(lists: list) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]), pa.int32())


def _trees(pages: list[str | None]) -> pa.Array:
    """The trees of some pages, column by column."""
    collects = gc.isenabled()
    gc.disable()  # no element of a part refers in a circle; looking for such takes a third of the time
    try:
        read = [_read(p) for p in pages]
    finally:
        if collects:
            gc.enable()
    lists = [nodes for _, nodes, _ in read]
    columns = dict(zip(_FIELDS, zip(*chain.from_iterable(lists)))) or {f: () for f in _FIELDS}
    at = np.concatenate([np.arange(len(x), dtype=np.int32) for x in lists]) if lists else []
    classes = pa.ListArray.from_arrays(_offsets(columns["classes"]), pa.array(list(chain.from_iterable(columns["classes"])), pa.string()))
    pairs = list(chain.from_iterable(columns["attrs"]))
    attrs = pa.MapArray.from_arrays(_offsets(columns["attrs"]), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
    made = {"at": pa.array(at, pa.int32()), "classes": classes, "attrs": attrs}
    nodes = pa.StructArray.from_arrays([made[f.name] if f.name in made else pa.array(columns[f.name], f.type) for f in _NODE], fields=list(_NODE))
    whole = [pa.array([r[0] for r in read], pa.string()), pa.ListArray.from_arrays(_offsets(lists), nodes), pa.array([r[2] for r in read], pa.string())]
    return pa.StructArray.from_arrays(whole, names=["text", "nodes", "error"])


def _parts(html: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, pages) of parts of at most PART characters, or one page."""
    part: list[str | None] = []
    at = held = 0
    for i, page in enumerate(html):
        page = page.as_py()
        if part and held + len(page or "") > PART:
            yield at, part
            part, at, held = [], i, 0
        part.append(page)
        held += len(page or "")
    if part:
        yield at, part


def tree(html: Column) -> Column:
    """The tree of a short piece of markup; for tables of pages see planted()."""

    @F.arrow_udf(TYPE)
    def parse(pages: pa.Array) -> pa.Array:
        made = [_trees(part) for _, part in _parts(pages)]
        return pa.concat_arrays(made) if made else _trees([])

    return parse(html)


def planted(pages: DataFrame, html: str, name: str = "_t") -> DataFrame:
    """pages with the tree of their markup."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in _parts(b.column(html)):
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(part)).columns, _trees(part)], [*b.schema.names, name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema]
    return pages.mapInArrow(grow, ", ".join([*fields, f"`{name}` {TYPE}"]))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def select(nodes: Column, tag: str | None = None, cls: str | None = None, where: Callable[[Column], Column] | None = None) -> Column:
    """The elements of a tag, a class and a condition, in page order."""

    def fits(n: Column) -> Column:
        tests = [n["tag"] == tag] * (tag is not None) + ([F.array_contains(n["classes"], cls)] if cls else []) + ([where(n)] if where else [])
        out = F.lit(True)
        for t in tests:
            out = out & t
        return F.coalesce(out, F.lit(False))

    return F.filter(nodes, fits)


def parent(nodes: Column, n: Column) -> Column:
    return F.get(nodes, n["parent"])


def within(n: Column, outer: Column) -> Column:
    """Whether n stands inside outer."""
    return (n["at"] > outer["at"]) & (n["at"] <= outer["last"])


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def nearest(nodes: Column) -> Column:
    """Of elements that all hold one other the innermost."""
    return F.try_element_at(nodes, F.lit(-1))


def squeezed(text: Column) -> Column:
    """Single blanks for white space of any kind, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def raw_text(text: Column, n: Column) -> Column:
    return F.substring(text, n["text_from"] + 1, n["text_to"] - n["text_from"])


def joined(text: Column, string: str = "", block: str = "") -> Column:
    """A tree's text with something at the ends of strings and of blocks, else nothing."""
    return F.replace(F.replace(text, F.lit(STRING), F.lit(string)), F.lit(BLOCK), F.lit(block))


def text_of(text: Column, n: Column) -> Column:
    """The strings inside an element without anything between them, blanks squeezed."""
    return squeezed(joined(raw_text(text, n)))


def inner_html(html: Column, n: Column) -> Column:
    return F.substring(html, n["html_from"] + 1, n["html_to"] - n["html_from"])
