"""Sinks: texts, DOCX and EPUB files as binary rows, in-place EPUB rewriting, versioned tables."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator
from html import escape
from xml.sax.saxutils import escape as xml

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import effective, output_tag
from ..sources.html import leaf_elements

FILES = "project_id string, file_name string, content binary"


def ordered_rows(paragraphs: DataFrame, chapters: DataFrame, projects: DataFrame) -> DataFrame:
    """What a document needs, a row a paragraph: titles, order, tag, shown text."""
    p = paragraphs.select("project_id", "chapter_id", "para_id", "para_index", output_tag(F.coalesce("tag", F.lit("p"))).alias("tag"), F.coalesce(effective(F.col("translated_text"), F.col("original_text")), F.lit("")).alias("text"))
    c = chapters.select("project_id", "chapter_id", F.coalesce("title", F.lit("")).alias("chapter_title"), "chapter_order")
    return p.join(c, ["project_id", "chapter_id"]).join(projects.select("project_id", F.coalesce("title", F.lit("")).alias("book_title"), F.coalesce("author", F.lit("")).alias("author")), "project_id")


def docx_bytes(title: str, rows: list[tuple[str, str]]) -> bytes:
    """rows: (tag, text)."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def para(style: str, text: str) -> str:
        return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t xml:space="preserve">{xml(text)}</w:t></w:r></w:p>'

    styles = [("Title", "title"), *[(f"Heading{i}", f"heading {i}") for i in range(1, 7)], ("Quote", "quote"), ("Normal", "normal")]
    body = para("Title", title) + "".join(para(f"Heading{t[1]}" if len(t) == 2 and t[0] == "h" else "Quote" if t == "blockquote" else "Normal", x) for t, x in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/_rels/document.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("word/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:styles {w}>' + "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in styles) + "</w:styles>")
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {w}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def epub_bytes(title: str, author: str, chapters: list[tuple[str, list[tuple[str, str]]]], language: str = "vi") -> bytes:
    """chapters: (title, rows of (tag, text)); mimetype comes first and is stored."""
    names = [f"text/ch{i:04d}.xhtml" for i in range(len(chapters))]
    items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
    nav = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters))
    points = "".join(f'<navPoint id="n{i}" playOrder="{i + 1}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}"/></navPoint>' for i, (n, (t, _)) in enumerate(zip(names, chapters)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/book.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>{language}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{refs}</spine></package>')
        z.writestr("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>')
        z.writestr("OEBPS/toc.ncx", f'<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><navMap>{points}</navMap></ncx>')
        for n, (t, rows) in zip(names, chapters):
            first = bool(rows) and rows[0][0][:1] == "h" and " ".join(rows[0][1].split()) == " ".join(t.split())
            body = ("" if first or not t else f"<h1>{escape(t)}</h1>") + "".join(f"<{tag}>{escape(x)}</{tag}>" for tag, x in rows)
            z.writestr("OEBPS/" + n, f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(t)}</title></head><body>{body}</body></html>')
    return out.getvalue()


def _chapters(pdf: pd.DataFrame) -> list[tuple[str, list[tuple[str, str]]]]:
    pdf = pdf.sort_values(["chapter_order", "chapter_id", "para_index", "para_id"], kind="stable")
    return [(g["chapter_title"].iloc[0], list(zip(g["tag"], g["text"]))) for _, g in pdf.groupby(["chapter_order", "chapter_id"], sort=True)]


def export_files(rows: DataFrame, kind: str) -> DataFrame:
    """FILES of the rows of ordered_rows, one file a project; a file is made where its rows are."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        project, title, author = pdf["project_id"].iloc[0], pdf["book_title"].iloc[0], pdf["author"].iloc[0]
        chapters = _chapters(pdf)
        content = epub_bytes(title, author, chapters) if kind == "epub" else docx_bytes(title, [r for t, rs in chapters for r in ([] if rs and rs[0][1] == t else [("h1", t)]) + rs])
        return pd.DataFrame({"project_id": [project], "file_name": [f"{project}.{kind}"], "content": [content]})

    return rows.groupBy("project_id").applyInPandas(make, FILES)


def rewrite_epub(data: bytes, texts: dict[tuple[str, int], str]) -> bytes:
    """The EPUB with the texts put at (document path, element ordinal); everything else as it was, mimetype first and stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), src.read("mimetype"), zipfile.ZIP_STORED)
        for n in src.namelist():
            if n == "mimetype":
                continue
            mine = {i: t for (doc, i), t in texts.items() if doc == n or n.endswith("/" + doc)}
            body = src.read(n)
            z.writestr(n, _replaced(body.decode("utf-8"), mine).encode() if mine else body)
    return out.getvalue()


def _replaced(page: str, texts: dict[int, str]) -> str:
    """Elements by ordinal, found again by their text in order."""
    at = 0
    for i, tag, text, _, _ in leaf_elements(page):
        if i in texts and text:
            start = page.find(f"<{tag}", at)
            while start >= 0:
                inner = page.find(">", start) + 1
                end = page.find(f"</{tag}>", inner)
                if end >= 0 and leaf_elements(page[start : end + len(tag) + 3])[:1] and leaf_elements(page[start : end + len(tag) + 3])[0][2] == text:
                    page = page[:inner] + escape(texts[i]) + page[end:]
                    at = inner
                    break
                start = page.find(f"<{tag}", start + 1)
    return page


def write_texts(documents: DataFrame, path: str) -> None:
    """One text part a task; documents: project_id, document."""
    documents.select("document").write.mode("overwrite").text(path)


def write_binary(files: DataFrame, uri: str) -> DataFrame:
    """FILES (file_name, content) to a folder of any file system, written by the tasks that hold them, each by a rename; file_name of each.

    The files are written when the result is read; a lost task writes its files again.
    """

    def save(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))
        store.create_dir(base, recursive=True)
        for pdf in filter(len, it):
            for name, content in zip(pdf["file_name"], pdf["content"]):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(bytes(content))
                store.move(part, f"{base}/{name}")
            yield pdf[["file_name"]]

    return files.select("file_name", "content").mapInPandas(save, "file_name string")


def versions(spark: SparkSession, root: str) -> list[int]:
    """The whole versions of a table: those whose last write has left its mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(s.getPath().getParent().getName()[1:]) for s in found or ())


def append_version(df: DataFrame, root: str, seen: int) -> int:
    """A new version of a table beside the old ones, made of version ``seen`` (0: of none); its number.

    A version that has come in the meantime is never overwritten: the caller must read it first.
    """
    spark = df.sparkSession
    newest = max(versions(spark, root), default=0)
    if newest != seen:
        raise ValueError(f"version {newest} has come after version {seen}")
    df.write.mode("errorifexists").parquet(f"{root}/v{seen + 1:06d}")
    return seen + 1


def current_version(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    newest = versions(spark, root)[-1]
    return spark.read.parquet(f"{root}/v{newest:06d}"), newest


def edited(df: DataFrame, running: set[str], project_id: str) -> DataFrame:
    """The rows to be edited of a project; a running one is locked."""
    if project_id in running:
        raise ValueError("the project is running")
    return df.filter(F.col("project_id") == project_id)


def without_project(df: DataFrame, project_id: str, running: set[str] = frozenset()) -> DataFrame:
    """The rows of all other projects; a running project is not deleted."""
    if project_id in running:
        raise ValueError("the project is running")
    return df.filter(F.coalesce(F.col("project_id") != project_id, F.lit(True)))
