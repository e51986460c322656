"""Book files to rows: dispatch by extension, decoding of TXT, Markdown, DOCX and EPUB in Python workers.

PDF files enter as layout rows (spans, blocks) that another tool has extracted. A file that
cannot be decoded gives one row with an error and no text; the rest of the batch goes on.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import leaf_elements, parse, visible_text

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LINE_ENDS = re.compile("\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]")
LIMIT = 100 * 1024 * 1024
SCHEMA = "path string, kind string, doc string, pos int, tag string, style string, text string, anchor string, error string"


def docx_rows(data: bytes) -> list[tuple[str, int, str, str]]:
    """(doc, pos, style, text) of the non-empty paragraphs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                names[s.get(f"{W}styleId")] = (name.get(f"{W}val") if name is not None else "").lower()
    out = []
    for pos, p in enumerate(body.iter(f"{W}p")):
        style = p.find(f"{W}pPr/{W}pStyle")
        ident = style.get(f"{W}val") if style is not None else ""
        text = "".join(t.text or "" if t.tag == f"{W}t" else " " for t in p.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))
        if text.strip():
            out.append(("document", pos, names.get(ident, ident.lower()) or "normal", text.strip()))
    return out


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def epub_parts(data: bytes) -> dict:
    """title, author, cover, spine [(path, linear, is_nav)], toc [(pos, parent, depth, title, path, fragment)], elements [(path, ...)]."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf_path = next(e.get("full-path") for e in box.iter() if _local(e.tag) == "rootfile")
        opf, base = ElementTree.fromstring(z.read(opf_path)), posixpath.dirname(opf_path)
        meta = {_local(e.tag): (e.text or "").strip() for e in reversed(list(opf.iter())) if _local(e.tag) in ("title", "creator")}
        items = {e.get("id"): e for e in opf.iter() if _local(e.tag) == "item"}

        def full(href: str, at: str = base) -> str:
            return posixpath.normpath(posixpath.join(at, unquote(href).replace("\\", "/")))

        names = set(z.namelist())
        spine, elements, toc = [], [], []
        nav = next((full(i.get("href")) for i in items.values() if "nav" in (i.get("properties") or "").split()), None)
        for ref in (e for e in opf.iter() if _local(e.tag) == "itemref"):
            item = items.get(ref.get("idref"))
            path = full(item.get("href")) if item is not None else None
            spine.append((path if path in names else None, ref.get("linear") or "yes", path is not None and path == nav))
            if path in names:
                page = z.read(path).decode("utf-8", "ignore")
                elements += [(path, *e) for e in leaf_elements(page)]
        cover = next((n for n in sorted(names) if re.search(r"(?:cover|front)[^/]*\.(?:jpe?g|png|gif)$", n, re.I)), None)
        ncx = next((full(i.get("href")) for i in items.values() if (i.get("media-type") or "").endswith("ncx+xml")), None)
        if ncx in names:
            _ncx(ElementTree.fromstring(z.read(ncx)), posixpath.dirname(ncx), full, toc)
        elif nav in names:
            _nav(parse(z.read(nav).decode("utf-8", "ignore")), posixpath.dirname(nav), full, toc)
    return {"title": meta.get("title", ""), "author": meta.get("creator", ""), "cover": cover, "spine": spine, "toc": toc, "elements": elements}


def _entry(toc: list, parent: int | None, depth: int, title: str, href: str, at: str, full) -> int:
    path, _, fragment = (href or "").partition("#")
    toc.append((len(toc), parent, depth, title, full(path, at) if path else "", fragment))
    return len(toc) - 1


def _ncx(root, at: str, full, toc: list) -> None:
    def walk(node, parent, depth):
        for point in (c for c in node if _local(c.tag) == "navPoint"):
            title = next((t.text or "" for t in point.iter() if _local(t.tag) == "text"), "")
            src = next((c.get("src") for c in point if _local(c.tag) == "content"), "")
            walk(point, _entry(toc, parent, depth, title.strip(), src, at, full), depth + 1)

    walk(next(e for e in root.iter() if _local(e.tag) == "navMap"), None, 0)


def _nav(root, at: str, full, toc: list) -> None:
    def find(node):
        for c in node.children:
            if not isinstance(c, str):
                if c.tag == "nav" and "toc" in (c.attrs.get("epub:type") or "toc").split():
                    return c
                if hit := find(c):
                    return hit
        return None

    def walk(node, parent, depth):
        for li in (c for c in node.children if not isinstance(c, str) and c.tag == "li"):
            link = next((c for c in li.children if not isinstance(c, str) and c.tag in ("a", "span")), None)
            own = _entry(toc, parent, depth, visible_text(link) if link else "", link.attrs.get("href", "") if link else "", at, full)
            for ol in (c for c in li.children if not isinstance(c, str) and c.tag == "ol"):
                walk(ol, own, depth + 1)

    nav = find(root)
    for ol in (c for c in (nav.children if nav else ()) if not isinstance(c, str) and c.tag == "ol"):
        walk(ol, None, 0)


def decode(path: str, data: bytes) -> list[tuple]:
    """Rows of SCHEMA of one file."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    try:
        if not data:
            raise ValueError("the file is empty")
        if len(data) > LIMIT:
            raise ValueError("the file is too large")
        if kind in ("txt", "md"):
            return [(path, kind, "", i, "line", "", line, "", None) for i, line in enumerate(LINE_ENDS.split(data.decode("utf-8", "ignore")))]
        if kind == "docx":
            return [(path, kind, d, i, "p", style, text, "", None) for d, i, style, text in docx_rows(data)]
        if kind == "epub":
            parts = epub_parts(data)
            rows = [(path, kind, p, i, tag, css, text, anchor, None) for p, i, tag, text, anchor, css in parts["elements"]]
            rows += [(path, kind, p or "", i, "spine", "nav" if nav else linear, "", "", None if p else "unresolved spine item") for i, (p, linear, nav) in enumerate(parts["spine"])]
            rows += [(path, kind, "", 0, k, "", parts[k], "", None) for k in ("title", "author", "cover") if parts.get(k)]
            return rows + [(path, kind, p, i, "toc", f"{'' if up is None else up}/{depth}", title, frag, None) for i, up, depth, title, p, frag in parts["toc"]]
        raise ValueError(f"no decoder for .{kind}")
    except Exception as e:
        return [(path, kind, "", 0, "error", "", None, "", f"{type(e).__name__}: {e}"[:300])]


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA of all files under a path, a file a task row."""
    from ..session import importable

    importable(spark)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            for p, data in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(decode(p, bytes(data)), columns=[c.split()[0] for c in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = files.filter(F.col("length") <= LIMIT)  # the source skips the others without reading them
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    none = F.lit("")
    large = files.filter(F.col("length") > LIMIT).select("path", kind, none, F.lit(0), F.lit("error"), none, F.lit(None).cast("string"), none, F.lit("ValueError: the file is too large"))
    return fits.select("path", "content").mapInPandas(run, SCHEMA).union(large)


def ocr_pages(pages: DataFrame, cache: DataFrame, recognise, tries: int = 4) -> DataFrame:
    """project_id, page, text, error of the pages (with image) that the cache lacks; recognise(bytes) -> str, at most ``tries`` calls a page."""
    todo = pages.join(cache.select("project_id", "page"), ["project_id", "page"], "left_anti")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            out = []
            for p, n, image in zip(pdf["project_id"], pdf["page"], pdf["image"]):
                text, error = None, None
                for _ in range(tries):
                    try:
                        text, error = recognise(bytes(image)), None
                        if text and text.strip():
                            break
                        error = "blank"
                    except Exception as e:
                        error = str(e)[:200]
                out.append((p, n, text if error is None else None, error))
            yield pd.DataFrame(out, columns=["project_id", "page", "text", "error"])

    return todo.select("project_id", "page", "image").mapInPandas(run, "project_id string, page int, text string, error string")


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of the primary decoder, and the fallback's for keys whose primary rows hold an error."""
    failed = primary.filter("error is not null").select(key).distinct()
    kept = primary.join(failed, key, "left_anti")
    second = fallback.join(failed, key, "left_semi").withColumn("error", F.coalesce("error", F.lit("decoded by the fallback")))
    return kept.unionByName(second)
