"""Sectioning of DOCX, textbook and number-line sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_chapter_line

#: Patterns of the lines of Vietnamese textbooks; fixed values.
CHAPTER_LINE = r"(?iu)^(?:#\s+)?(Chương\s+[0-9IVXLCDMivxlcdm]+[:.\-–\s]*.*|Lời\s+(?:Nhà\s+xuất\s+bản|nói\s+đầu|mở\s+đầu)|Tài\s+liệu\s+tham\s+khảo|Kết\s+luận)$"
MAJOR, ROMAN, SUB = r"(?iu)^(?:##\s+)?([A-C]\.\s+.*)$", r"(?iu)^(?:###\s+)?([IVXLCDM]+[.\-–\s]+.*)$", r"^(?:####\s+)?(\d+\.\s+.*)$"
ALONE = r"(?iu)^(?:#\s*)?(Chương\s+[0-9IVXLCDMivxlcdm]+)\s*$"


def docx_sections(rows: DataFrame) -> DataFrame:
    """rows: doc, pos, style, text. A section starts at the strongest heading level or a title, else at chapter lines."""
    doc = Window.partitionBy("doc")
    level = F.nullif(F.regexp_extract("style", r"^heading ([1-6])$", 1), F.lit("")).cast("int")
    r = rows.withColumn("level", level).withColumn("top", F.min("level").over(doc))
    start = F.coalesce(F.col("level") == F.col("top"), F.lit(False)) | (F.col("style") == "title")
    start |= F.col("top").isNull() & is_chapter_line(F.col("text"), strict=True)
    r = r.withColumn("start", start)
    tag = F.when(F.col("level").isNotNull(), F.concat(F.lit("h"), F.col("level"))).when(F.col("start"), "h1").otherwise("p")
    return r.select("doc", "pos", F.sum(F.col("start").cast("int")).over(doc.orderBy("pos")).cast("long").alias("section"), tag.alias("tag"), "text")


def textbook_rows(lines: DataFrame) -> DataFrame:
    """lines: doc, pos, line. Chapters by their lines (no rows themselves), headings, quotes and joined paragraphs.

    A bare chapter line takes the next line as its title; a hyphen at a line's end is joined.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    r = lines.withColumn("line", F.trim("line"))
    takes = F.col("line").rlike(ALONE) & (F.coalesce(F.lead("line").over(w), F.lit("")) != "") & ~F.coalesce(F.lead("line").over(w), F.lit("#")).rlike(r"^(?:#|A\.|B\.|C\.|I-|II-)")
    r = r.withColumn("_takes", takes).withColumn("_next", F.lead("line").over(w)).withColumn("_taken", F.coalesce(F.lag("_takes").over(w), F.lit(False)))
    r = r.filter(~F.col("_taken")).withColumn("line", F.when(F.col("_takes"), F.concat(F.regexp_extract("line", ALONE, 1), F.lit(": "), "_next")).otherwise(F.col("line")))
    kind = F.when(F.col("line") == "", "blank").when(F.col("line").rlike(CHAPTER_LINE), "chapter").when(F.col("line").rlike(MAJOR), "h2").when(F.col("line").rlike(ROMAN), "h3").when(F.col("line").rlike(SUB), "h4").when(F.col("line").startswith(">"), "blockquote").otherwise("p")
    clean = F.when(F.col("line").startswith(">"), F.regexp_replace("line", "^[> ]+", "")).otherwise(F.regexp_replace("line", r"^#+\s*", ""))
    r = r.withColumn("kind", kind).withColumn("clean", F.trim(clean))
    # A paragraph is a run of plain lines: it breaks before and after every other kind.
    brk = ((F.col("kind") != "p") | (F.coalesce(F.lag("kind").over(w), F.lit("")) != "p")).cast("int")
    r = r.withColumn("_brk", brk).withColumn("run", F.sum("_brk").over(w)).withColumn("chapter", F.sum((F.col("kind") == "chapter").cast("int")).over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "clean"))), lambda x: x["clean"]), "␟")
    out = r.filter("kind != 'blank'").groupBy("doc", "chapter", "run", "kind").agg(text.alias("t"))
    out = out.withColumn("text", F.replace(F.regexp_replace("t", "-␟", ""), F.lit("␟"), F.lit(" ")))
    return out.select("doc", F.col("chapter").cast("long").alias("chapter"), F.row_number().over(Window.partitionBy("doc").orderBy("run")).cast("long").alias("place"), F.col("kind").alias("tag"), "text")


def number_headings(lines: DataFrame) -> DataFrame:
    """lines: doc, block, pos, line. A line of a section number only and the capitalised line after it form a heading."""
    w = Window.partitionBy("doc", "block").orderBy("pos")
    nxt = F.lead("line").over(w)
    r = lines.withColumn("next", nxt)
    hit = F.col("line").rlike(r"^\d{1,2}(?:\.\d{1,2})*\.?$") & F.coalesce(F.col("next").rlike(r"^[A-Z]"), F.lit(False))
    return r.filter(hit).select("doc", "block", F.concat("line", F.lit(" "), "next").alias("heading"), F.when(F.col("line").contains("."), 2).otherwise(1).cast("long").alias("level"))


def segments(lines: DataFrame, start) -> DataFrame:
    """lines (doc, pos, line) with section (from 0) and place in it: a section begins at each row of ``start``; sections without content are dropped and the rest renumbered.

    The lines that start sections are no content; what stands before the first start is a section of its own.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    rows = lines.withColumn("_start", F.coalesce(start, F.lit(False))).withColumn("_group", F.sum(F.col("_start").cast("int")).over(w))
    content = rows.filter(~F.col("_start") & (F.trim("line") != ""))
    section = F.dense_rank().over(Window.partitionBy("doc").orderBy("_group")) - 1
    place = F.row_number().over(Window.partitionBy("doc", "_group").orderBy("pos")) - 1
    return content.select("doc", section.cast("long").alias("section"), place.cast("long").alias("place"), "pos", "line")
