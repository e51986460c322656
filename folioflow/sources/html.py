"""Leaf text elements of (X)HTML pages: one row an element with its ordinal."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAVES = frozenset(["h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "li", "div", "hr"])
HOLDERS = frozenset(["div", "blockquote", "li"])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset(["script", "style", "title", "head"])
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent


class _Builder(HTMLParser):
    """A tree that tolerates open paragraphs and list items and stray end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self._inside("p"):
            self.handle_endtag("p")
        if tag == "li" and self._inside("li", stop=("ul", "ol")):
            self.handle_endtag("li")
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def _inside(self, tag, stop=()):
        n = self.at
        while n is not self.root and n.tag not in stop:
            if n.tag == tag:
                return True
            n = n.parent
        return False


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def visible_text(node: Node | str) -> str:
    """Text nodes joined, line breaks as spaces, white space collapsed, no replacement characters."""
    out: list[str] = []

    def walk(x):
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        elif x.tag not in SKIPPED:
            for c in x.children:
                walk(c)

    walk(node)
    return re.sub(r"\s+", " ", "".join(out).replace("�", "")).strip()


def _has_leaf(node: Node | str) -> bool:
    return isinstance(node, Node) and any(isinstance(c, Node) and (c.tag in LEAVES or _has_leaf(c)) for c in node.children)


def leaf_elements(html: str | None) -> list[tuple[int, str, str, str, str]]:
    """(ordinal, tag, text, id, class) of the elements without a candidate inside.

    Loose text in a holder that also has candidates becomes a p of its own. Empty elements keep
    their ordinal but have no row, except rules.
    """
    root = parse(html or "")

    def wrap(node: Node):
        for c in list(node.children):
            if isinstance(c, Node):
                wrap(c)
        if node.tag in HOLDERS and _has_leaf(node):
            new, run = [], []

            def flush():
                if run:
                    p = Node("p", {}, node)
                    p.children = list(run)
                    new.extend([p] if visible_text(p) else run)
                    run.clear()

            for c in node.children:
                if isinstance(c, Node) and (c.tag in LEAVES or _has_leaf(c)):
                    flush()
                    new.append(c)
                else:
                    run.append(c)
            flush()
            node.children = new

    wrap(root)
    out: list[tuple[int, str, str, str, str]] = []
    count = 0

    def collect(node: Node):
        nonlocal count
        for c in node.children:
            if not isinstance(c, Node) or c.tag in SKIPPED:
                continue
            if c.tag in LEAVES and not _has_leaf(c):
                text = visible_text(c)
                if text or c.tag == "hr":
                    out.append((count, c.tag, text, c.attrs.get("id") or "", c.attrs.get("class") or ""))
                count += 1
            else:
                collect(c)

    collect(root)
    return out


def explode_elements(pages: DataFrame, key: str, html_col: str = "html") -> DataFrame:
    """key, element_index, tag, text, anchor, css of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            rows = [(k, *e) for k, h in zip(pdf[key], pdf[html_col]) for e in leaf_elements(h)]
            yield pd.DataFrame(rows, columns=[key, "element_index", "tag", "text", "anchor", "css"])

    return pages.select(key, F.col(html_col)).mapInPandas(run, f"{key} {kind}, element_index int, tag string, text string, anchor string, css string")
