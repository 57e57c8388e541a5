"""Pages of markup: clean text, light markdown, table grids, safe HTML.

A page is read once as a stream of tags and texts. What a tag does is looked up by its name: it
breaks lines, opens or closes a mark, holds no text of the page at all, or nothing. Pages reach
Python in Arrow batches; a page is one row there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEANINGFUL = 200
#: Named entities that are decoded.
ENTITIES = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "ndash": "–", "mdash": "—", "hellip": "…",
    "lsquo": "'", "rsquo": "'", "ldquo": "“", "rdquo": "”",
}
#: Line ends where a tag begins or closes, by name.
OPENING = {"br": "\n", "hr": "\n---\n", "td": "| ", "th": "| **"}
CLOSING = {"td": " ", "th": "** "} | dict.fromkeys(("p", "div", "li", "tr", "blockquote", "section", "article", *(f"h{i}" for i in range(1, 7))), "\n\n")
#: Tags whose content is no text of the page; a mark around the content of others.
HIDDEN = {"head", "script", "style"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
#: What markdown adds: headings and list items begin with a sign.
SIGNS = {f"h{i}": "\n\n" + "#" * i + " " for i in range(1, 7)} | {"li": "\n- "}

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)(?P<rest>[^>]*)>|<[^>]*>", re.DOTALL)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_ENTITY = re.compile(r"&(?:#(\d{1,10})|#[xX]([0-9a-fA-F]{1,8})|([a-z]+));|&#\d{11,};")


def decoded(text: str) -> str:
    """The text without entities: known names and valid code points become characters, invalid numbers nothing."""

    def one(m: re.Match) -> str:
        if m[3]:
            return ENTITIES.get(m[3], m[0])
        code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else 0
        return chr(code) if 0 < code < 0xD800 or 0xE000 <= code <= 0x10FFFF else ""

    return _ENTITY.sub(one, text) if "&" in text else text


def stream(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, rest) in order: kinds are text, open and close. Hidden content and comments are left out."""
    at, low = 0, page.lower()
    while at < len(page):
        m = _TOKEN.search(page, at)
        yield "text", page[at : m.start() if m else len(page)], ""
        if not m:
            return
        at = m.end()
        if m["name"] is None:
            yield "text", " " if m[0].startswith("<!--") else "", ""
            continue
        name = m["name"].lower()
        yield "close" if m["end"] else "open", name, m["rest"]
        if name in HIDDEN and not m["end"]:
            close = low.find(f"</{name}", at)
            if close < 0 and name == "head":
                continue
            at = len(page) if close < 0 else close


def tidy(text: str) -> str:
    """Single blanks, at most one empty line, nothing at the ends of lines or of the text."""
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def readable(page: str | None, markdown: bool = False) -> str:
    """The text of a page with light marks; with `markdown` also headings, list items and links."""
    out: list[str] = []
    open_marks: list[tuple[str, int]] = []
    links: list[tuple[str, int]] = []
    for kind, name, rest in stream((page or "").replace("\r\n", "\n").replace("\r", "\n")):
        if kind == "text":
            out.append(decoded(name))
        elif name in MARKS:
            if kind == "open":
                open_marks.append((MARKS[name], len(out)))
                out.append("")
            elif any(mark == MARKS[name] for mark, _ in open_marks):
                # A mark only stands where the tag is closed; those opened inside and left open are none.
                while (last := open_marks.pop())[0] != MARKS[name]:
                    pass
                out[last[1]] = last[0]
                out.append(last[0])
        elif markdown and name == "a":
            if kind == "open" and (m := _HREF.search(rest)):
                links.append((m[1] or m[2] or m[3] or "", len(out)))
                out.append("")
            elif kind == "close" and links:
                target, began = links.pop()
                out[began] = "["
                out.append(f"]({target})")
        elif kind == "open":
            out.append(OPENING.get(name, "") + (SIGNS.get(name, "") if markdown else ""))
        else:
            out.append(CLOSING.get(name, ""))
    return tidy("".join(out))


def clean_text(html: Column) -> Column:
    """Plain text with light marks, empty for null."""

    @F.pandas_udf("string")
    def clean(pages: pd.Series) -> pd.Series:
        return pages.map(readable, na_action=None)

    return clean(html)


def markdown_text(html: Column) -> Column:
    """Clean text with headings, list items and links."""

    @F.pandas_udf("string")
    def mark(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: readable(p, markdown=True), na_action=None)

    return mark(html)


def is_meaningful(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= MEANINGFUL


class _Cells(HTMLParser):
    """Rows of (row, column span, row span, text) cells of all tables."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            span = [int(a[k]) if str(a.get(k) or "").isdigit() and int(a[k]) > 0 else 1 for k in ("colspan", "rowspan")]
            self.tables[-1][-1].append([*span, ""])
            self.open = True

    def handle_endtag(self, tag: str) -> None:
        self.open = self.open and tag not in ("td", "th", "tr", "table")

    def handle_data(self, data: str) -> None:
        if self.open:
            self.tables[-1][-1][-1][2] += data


def grids(html: str) -> list[list[list[str]]]:
    """Every table as a rectangle of texts; spans repeat as empty cells."""
    p = _Cells()
    p.feed(html)
    out = []
    for rows in p.tables:
        held: dict[tuple[int, int], str] = {}
        for r, row in enumerate(rows):
            c = 0
            for across, down, text in row:
                while (r, c) in held:
                    c += 1
                for i in range(min(down, len(rows) - r)):
                    for j in range(across):
                        held[r + i, c + j] = " ".join(text.split()) if not (i or j) else ""
                c += across
        width = max((c + 1 for _, c in held), default=0)
        out.append([[held.get((r, c), "") for c in range(width)] for r in range(len(rows))])
    return out


def table_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, cells, line): grids of all tables, each row also as a pipe line."""

    @F.pandas_udf("array<struct<table:int,row:int,cells:array<string>>>")
    def cut(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: [{"table": t, "row": r, "cells": row} for t, g in enumerate(grids(h or "")) for r, row in enumerate(g)])

    e = df.select(key, F.explode(cut(F.col(html))).alias("t")).select(key, "t.*")
    return e.withColumn("line", F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |")))


def safe_html(markdown: str | Column) -> Column:
    """Markdown to HTML that is escaped before any tag is made: headings, lists, emphasis, paragraphs. No Python:
    blocks are an array, and each block is a case of expressions."""
    text = F.col(markdown) if isinstance(markdown, str) else markdown
    blocks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), _stripped), lambda b: b != "")
    return F.array_join(F.transform(blocks, _block_html), "")


def _stripped(b: Column) -> Column:
    return F.regexp_replace(b, r"(?U)^\s+|\s+$", "")


def _block_html(block: Column) -> Column:
    b = block
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        b = F.replace(b, F.lit(char), F.lit(name))
    b = F.regexp_replace(F.regexp_replace(b, r"\*\*(.+?)\*\*", "<strong>$1</strong>"), r"\*(.+?)\*", "<em>$1</em>")
    level = F.length(F.regexp_extract(b, r"^(#{1,6})\s+[^\n]*$", 1)).cast("string")
    title = F.regexp_extract(b, r"^#{1,6}\s+([^\n]*)$", 1)
    heading = F.concat(F.lit("<h"), level, F.lit(">"), title, F.lit("</h"), level, F.lit(">"))
    lines = F.split(b, "\n")
    items = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<li>"), F.substring(x, 3, 1 << 30), F.lit("</li>"))), "")
    return (
        F.when(level != "0", heading)
        .when(F.forall(lines, lambda x: x.startswith("- ")), F.concat(F.lit("<ul>"), items, F.lit("</ul>")))
        .otherwise(F.concat(F.lit("<p>"), F.replace(b, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    )

