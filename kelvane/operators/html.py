"""Parsing of HTML in Arrow batches with the standard library's parser.

``visible`` gives a page's text, ``blocks`` its contact blocks, ``json_ld`` its structured organisations and
publishers. Only these need a parser; what a regular expression can find is in ``extract``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_UNSEEN = {"script", "style", "noscript", "svg", "iframe", "template"}
_HEADINGS = {"h1", "h2", "h3", "h4"}
#: White space of HTML but the blank, and blanks of any alphabet.
_SPACE = re.compile(r"[\t\n\f\r]")
_BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_BOUNDS = {"section", "article", "address", "footer"}
ORGANISATIONS = ("Organization", "Corporation", "LocalBusiness", "ProfessionalService", "Store")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def hidden(self) -> bool:
        style = (self.attrs.get("style") or "").replace(" ", "").lower()
        return self.tag in _UNSEEN or "hidden" in self.attrs or self.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style

    def joined(self, seen_only: bool = True) -> str:
        """The text as it is, with a blank for each tag."""
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                out.append(" ")
                if not (seen_only and x.hidden()):
                    todo += [" ", *reversed(x.children)]
        return "".join(out)

    def text(self, seen_only: bool = True) -> str:
        return " ".join(self.joined(seen_only).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None)

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines and columns

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        node.children.append(" ")
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)  # a bare < comes on its own, so a text may come in pieces

    def handle_comment(self, data: str) -> None:
        self.at.children.append(" ")

    handle_decl = handle_pi = unknown_decl = handle_comment


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


@F.pandas_udf(StringType())
def _visible(pages: pd.Series) -> pd.Series:
    return pages.map(lambda h: parse(h).text())


def written(source: str | None) -> str | None:
    """What ``visible`` gives for one page with ``decoded=False``."""
    if source is None:
        return None
    seen = parse(source.replace("&", "&amp;")).joined()  # the parser decodes each reference once, which restores the page's own
    return " ".join(filter(None, _SPACE.sub(" ", seen).split(" "))).strip(_BLANKS)


@F.pandas_udf(StringType())
def _written(pages: pd.Series) -> pd.Series:
    return pages.map(written)


def visible(html: Column, decoded: bool = True) -> Column:
    """Visible text: no scripts, styles, comments or hidden elements; white space squeezed.

    Not decoded: character references stay as the page has them, only HTML's own white space is squeezed, and null stays null.
    """
    return _visible(html) if decoded else _written(html)


def contact_block(node: Node) -> Node:
    """The nearest bounded ancestor: a section, article, address or footer, or a div with a heading; else the parent."""
    up = node.parent
    while up is not None and up.tag not in ("body", "html", "[document]"):
        if up.tag in _BOUNDS or (up.tag == "div" and any(n.tag in ("h2", "h3", "h4") for n in up.walk())):
            return up
        up = up.parent
    return node.parent or node


BLOCKS = "href string, publication string, headings array<string>, page_headings array<string>, visible_email string"


def page_blocks(source: str | None) -> list[dict]:
    """What ``blocks`` gives for one page."""
    root, rows = parse(source), []
    every = [n.text() for n in root.walk() if n.tag in _HEADINGS]
    for a in root.walk():
        href = a.attrs.get("href", "")
        if a.tag == "a" and href.lower().startswith(("mailto:", "tel:")):
            block, shown = contact_block(a), a.text()
            rows.append({"href": href, "publication": block.text()[:2000], "headings": [n.text() for n in block.walk() if n.tag in _HEADINGS], "page_headings": every, "visible_email": shown if "@" in shown else ""})
    return rows


def _exploded(pages: DataFrame, key: str, html: str, found: Callable[[str | None], list[dict]], fields: pa.Schema, schema: str) -> DataFrame:
    """``key`` and the rows that ``found`` gives for each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{key: k, **row} for k, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in found(source)]
            yield from pa.Table.from_pylist(rows, schema=pa.schema([(key, batch.schema.field(0).type), *fields])).to_batches()

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, {schema}")


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row for each mailto and tel link: its block's text (2,000 characters), the block's and the page's headings."""
    fields = pa.schema([("href", pa.string()), ("publication", pa.string()), ("headings", pa.list_(pa.string())), ("page_headings", pa.list_(pa.string())), ("visible_email", pa.string())])
    return _exploded(pages, key, html, page_blocks, fields, BLOCKS)


def _objects(value: object) -> Iterator[dict]:
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from _objects(v)
    elif isinstance(value, list):
        for v in value:
            yield from _objects(v)


OBJECTS = "position int, kind string, name string, url string"


def page_objects(source: str | None) -> list[dict]:
    """What ``json_ld`` gives for one page."""
    rows: list[dict] = []
    for script in (n for n in parse(source).walk() if n.tag == "script" and n.attrs.get("type") == "application/ld+json"):
        try:
            found = json.loads(script.text(seen_only=False))
        except ValueError:
            continue
        for o in _objects(found):
            types = o.get("@type") or []
            types = [types] if isinstance(types, str) else types
            name = lambda x: str(x.get("legalName") or x.get("name") or "")
            if any(t in ORGANISATIONS for t in types):
                rows.append({"position": len(rows), "kind": "ORGANIZATION", "name": name(o), "url": str(o.get("url") or "")})
            if "WebSite" in types and isinstance(o.get("publisher"), dict):
                rows.append({"position": len(rows), "kind": "PUBLISHER", "name": name(o["publisher"]), "url": str(o.get("url") or "")})
    return rows


def json_ld(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, kind, name, url): organisations, and publishers of WebSite objects, at any depth of a page's ld+json scripts."""
    fields = pa.schema([("position", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("url", pa.string())])
    return _exploded(pages, key, html, page_objects, fields, OBJECTS)
