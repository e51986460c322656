"""Operators over the tables projects, chapters and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import effective, html_escape, is_caption, is_footnote, is_table_caption, output_tag, squeeze, strip, word_count

PARA_KEY = ["project_id", "chapter_id", "para_id"]
COMPLETE = ("done", "edited")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last delivery of each key; ties go to the later columns of the order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def current_paragraphs(paragraphs: DataFrame) -> DataFrame:
    return latest(paragraphs, PARA_KEY, ["loaded_at", "row_id"])


def current_chapters(chapters: DataFrame) -> DataFrame:
    return latest(chapters, ["project_id", "chapter_id"], ["loaded_at", "chapter_row_id"])


def current_projects(projects: DataFrame) -> DataFrame:
    return latest(projects, ["project_id"], ["loaded_at"])


def is_complete(status: Column) -> Column:
    return F.coalesce(status.isin(*COMPLETE), F.lit(False))


def percent(part: Column, whole: Column, empty: float) -> Column:
    """Share in percent, one digit, half to even on the double."""
    return F.when(whole == 0, F.lit(empty)).otherwise(F.bround(part / whole * 100, 1))


def chapter_progress(paragraphs: DataFrame) -> DataFrame:
    done = F.count_if(is_complete(F.col("status")))
    out = paragraphs.groupBy("project_id", "chapter_id").agg(F.count("*").alias("total_rows"), done.alias("done_rows"), F.sum(word_count(F.col("original_text"))).alias("n_words"))
    out = out.withColumn("progress", percent(F.col("done_rows"), F.col("total_rows"), 100.0))
    badge = F.when(F.col("progress") >= 100, "done").when(F.col("progress") > 0, "progress").otherwise("pending")
    return out.withColumn("badge", badge)


def project_rollup(progress: DataFrame) -> DataFrame:
    """Totals of projects from the chapters' progress: partial sums, no second scan of texts."""
    out = progress.groupBy("project_id").agg(F.count("*").alias("chapters"), F.sum("total_rows").alias("total_rows"), F.sum("done_rows").alias("done_rows"), F.sum("n_words").alias("n_words"))
    return out.withColumn("progress", percent(F.col("done_rows"), F.col("total_rows"), 0.0))


def missing_pages(pages: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """project_id, page of the pages without text yet, from ``start`` to ``end``: all pages of each book by default.

    Only pages that a book has are looked at, so the range ends at the book's own first and last page.
    """
    wanted = pages.filter("page is not null")
    if start is not None:
        wanted = wanted.filter(F.col("page") >= start)
    if end is not None:
        wanted = wanted.filter(F.col("page") <= end)
    read = pages.filter(F.length(strip(F.col("translated_text"))) > 0).select("project_id", "page")
    return wanted.select("project_id", "page").join(read, ["project_id", "page"], "left_anti").distinct()


def cache_appended(cache: DataFrame, pages: DataFrame) -> DataFrame:
    """The cache (project_id, page, text) with the pages that are new to it and have text; the first of repeated pages stays."""
    new = pages.filter(F.length(strip(F.col("text"))) > 0).groupBy("project_id", "page").agg(F.min("text").alias("text"))
    return cache.unionByName(new.join(cache.select("project_id", "page"), ["project_id", "page"], "left_anti"))


def restarted(paragraphs: DataFrame) -> DataFrame:
    """All rows as before their first translation: what a forced run begins with."""
    return paragraphs.withColumn("status", F.lit("pending")).withColumn("translated_text", F.lit(""))


def project_type(document_type: Column, source_format: Column) -> Column:
    """The type, or for old projects paper for pdf and novel for the rest."""
    return F.when(F.coalesce(document_type, F.lit("")) != "", document_type).when(source_format == "pdf", "paper").otherwise("novel")


def chunk_candidates(paragraphs: DataFrame, only_pending: bool = True) -> DataFrame:
    """Rows for translation: no image, and no complete row where only pending ones are wanted."""
    rows = paragraphs.filter(F.coalesce(F.col("tag") != "img", F.lit(True)))
    return rows.filter(~is_complete(F.col("status"))) if only_pending else rows


def needing_work(progress: DataFrame, force: bool = False) -> DataFrame:
    return progress if force else progress.filter("progress < 100")


def chapter_number(chapter_id: Column) -> Column:
    """The numeric end of a chapter id, 9999 where there is none."""
    digits = F.regexp_extract(chapter_id, r"_(\d+)$", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(F.lit(9999).cast("long"))


def chapter_order() -> list[Column]:
    return [F.col("para_index"), F.col("para_id")]


def caption_pairs(paragraphs: DataFrame) -> DataFrame:
    """Images with the caption that follows them, and captions that stand alone."""
    w = Window.partitionBy("project_id", "chapter_id").orderBy("para_index", "para_id")
    rows = paragraphs.withColumn("_caption", is_caption(F.col("tag"), F.col("original_text"), F.col("translated_text")))
    rows = rows.withColumn("_next_caption", F.lead("_caption").over(w)).withColumn("_next_id", F.lead("para_id").over(w)).withColumn("_prev_tag", F.lag("tag").over(w))
    image = F.coalesce(F.col("tag") == "img", F.lit(False))
    kind = F.when(image & F.col("_next_caption"), "captioned_image").when(image, "image").when(F.col("_caption") & (F.col("_prev_tag") == "img"), "consumed").when(F.col("_caption"), "caption")
    table = is_table_caption(F.col("para_id"), F.col("original_text"), F.col("translated_text"))
    rows = rows.withColumn("kind", kind).filter("kind is not null and kind != 'consumed'")
    return rows.select(*PARA_KEY, "kind", F.when(F.col("kind") == "captioned_image", F.col("_next_id")).alias("caption_id"), F.when(F.col("kind") == "caption", table).alias("is_table"))


def title_duplicates(paragraphs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters whose first row is a heading with the chapter's own title."""
    first = paragraphs.groupBy("project_id", "chapter_id").agg(F.min_by(F.struct("tag", "original_text"), F.struct("para_index", "para_id")).alias("f"))
    both = chapters.join(first, ["project_id", "chapter_id"])
    same = F.col("f.tag").rlike("^h[1-6]$") & (squeeze(F.col("f.original_text")) == squeeze(F.col("title")))
    return both.select("project_id", "chapter_id", F.coalesce(same, F.lit(False)).alias("duplicate"))


def group_by_source(paragraphs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Rows by their source document, or the chapter's where they have none."""
    docs = chapters.select("project_id", "chapter_id", "doc_name")
    joined = paragraphs.join(docs, ["project_id", "chapter_id"], "left")
    source = F.coalesce(F.nullif(F.col("source_doc"), F.lit("")), F.nullif(F.col("doc_name"), F.lit("")), F.lit(""))
    return joined.groupBy("project_id", source.alias("source")).agg(F.count("*").alias("n_rows"), F.count_if(is_complete(F.col("status"))).alias("done_rows"))


def reader_view(paragraphs: DataFrame) -> DataFrame:
    """The text of each row in the reader's three modes."""
    has = F.coalesce(F.length(strip(F.col("translated_text"))), F.lit(0)) > 0
    o = F.coalesce("original_text", F.lit(""))
    vi = F.when(has, F.col("translated_text")).otherwise(F.concat(F.lit('[Chưa dịch: "'), F.substring(o, 1, 80), F.lit('…"]')))
    both = F.concat(o, F.lit("\n"), F.when(has, F.col("translated_text")).otherwise("[Đoạn này chưa dịch]"))
    heading = F.coalesce(F.lower("tag").rlike("^h[1-6]$"), F.lit(False))
    return paragraphs.select(*PARA_KEY, F.when(heading, F.lower("tag")).otherwise("p").alias("element"), o.alias("en_text"), vi.alias("vi_text"), both.alias("bilingual_text"))


def merged(paragraphs: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies (project_id, chapter_id, para_id, reply) put into their rows; a blank reply changes nothing."""
    text = F.nullif(strip(F.col("reply")), F.lit(""))
    out = paragraphs.join(replies, PARA_KEY, "left")
    return out.select(*PARA_KEY, F.coalesce(text, F.col("translated_text")).alias("translated_text"), F.when(text.isNotNull(), "done").otherwise(F.col("status")).alias("status"))


def duplicate_matches(paragraphs: DataFrame, elements: DataFrame) -> DataFrame:
    """Rows without a place of their own, matched with elements of equal text that no row has taken; repeated texts are taken in order.

    elements: project_id, source_doc, pos, text.
    """
    located = F.coalesce(F.col("source_element_index") >= 0, F.lit(False))
    taken = paragraphs.filter(located).select("project_id", "source_doc", F.col("source_element_index").alias("pos"))
    nth = F.row_number().over(Window.partitionBy("project_id", "source_doc", "_t").orderBy("para_index", "row_id"))
    rows = paragraphs.filter(~located).withColumn("_t", squeeze(F.col("original_text"))).withColumn("_n", nth)
    eth = F.row_number().over(Window.partitionBy("project_id", "source_doc", "_t").orderBy("pos"))
    els = elements.join(taken, ["project_id", "source_doc", "pos"], "left_anti").withColumn("_t", squeeze(F.col("text"))).withColumn("_n", eth)
    return rows.join(els, ["project_id", "source_doc", "_t", "_n"]).select("project_id", "source_doc", "row_id", "pos")


def substitutions(paragraphs: DataFrame) -> DataFrame:
    """The text for each place (document, element): the first complete row wins."""
    w = Window.partitionBy("project_id", "source_doc", "source_element_index").orderBy("para_index", "row_id")
    rows = paragraphs.filter((F.col("source_element_index") >= 0) & (F.coalesce("source_doc", F.lit("")) != ""))
    rows = rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return rows.select("project_id", "source_doc", "source_element_index", "row_id", effective(F.col("translated_text"), F.col("original_text")).alias("text"))


def text_export(paragraphs: DataFrame, chapters: DataFrame, projects: DataFrame, bilingual: bool) -> DataFrame:
    """One text a project: banner, chapter rules, rows in order.

    Lines are joined in two steps, per chapter and per project.
    """
    shown = effective(F.col("translated_text"), F.coalesce("original_text", F.lit("")))
    o = F.coalesce("original_text", F.lit(""))
    line = F.concat(F.lit("[EN] "), o, F.lit("\n[VI] "), shown, F.lit("\n")) if bilingual else F.concat(shown, F.lit("\n"))
    rows = paragraphs.select("project_id", "chapter_id", F.struct("para_index", "para_id", line.alias("line")).alias("s"))
    body = rows.groupBy("project_id", "chapter_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["line"]), "\n").alias("body"))
    dup = title_duplicates(paragraphs, chapters)
    chap = chapters.join(body, ["project_id", "chapter_id"]).join(dup, ["project_id", "chapter_id"])
    rule = F.when(F.col("duplicate"), F.lit("")).otherwise(F.concat(F.lit("\n\n--- "), F.coalesce("title", F.lit("")), F.lit(" ---\n\n")))
    chap = chap.select("project_id", F.struct("chapter_order", "chapter_id", F.concat(rule, "body").alias("part")).alias("s"))
    whole = chap.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["part"]), "\n").alias("body"))
    banner = F.concat(F.lit("=== "), "title", F.lit(" ===\nTác giả: "), "author", F.lit("\n" + "=" * 40 + "\n\n"))
    return projects.join(whole, "project_id").select("project_id", F.concat(banner, "body").alias("document"))


def html_fragment(paragraphs: DataFrame) -> DataFrame:
    """The HTML of each row: caption, footnote, heading or plain element."""
    shown = html_escape(effective(F.col("translated_text"), F.coalesce("original_text", F.lit(""))))
    tag = output_tag(F.coalesce("tag", F.lit("p")))
    caption = is_caption(F.col("tag"), F.col("original_text"), F.col("translated_text"))
    foot = is_footnote(effective(F.col("translated_text"), F.coalesce("original_text", F.lit(""))))
    html = (
        F.when(F.col("tag") == "img", F.concat(F.lit('<figure id="'), "para_id", F.lit('"></figure>')))
        .when(F.col("tag") == "hr", F.lit("<hr/>"))
        .when(caption, F.concat(F.lit('<p class="caption">'), shown, F.lit("</p>")))
        .when(foot, F.concat(F.lit('<p class="footnote">'), shown, F.lit("</p>")))
        .otherwise(F.concat(F.lit("<"), tag, F.lit(">"), shown, F.lit("</"), tag, F.lit(">")))
    )
    return paragraphs.select(*PARA_KEY, html.alias("html"))


def paper_flags(projects: DataFrame, chapters: DataFrame) -> DataFrame:
    """Whether a project is a paper: by its type, else by the titles of its chapters."""
    t = F.lower(strip(F.col("title")))
    named = chapters.groupBy("project_id").agg(F.coalesce(F.bool_or(t.isin("abstract", "tóm tắt")), F.lit(False)).alias("named"), F.coalesce(F.bool_or(t == "phần mở đầu / tiêu đề"), F.lit(False)).alias("opened"))
    joined = projects.select("project_id", "document_type", "source_format").join(named, "project_id", "left")
    flag = F.when(F.coalesce("document_type", F.lit("")) != "", F.col("document_type") == "paper").otherwise(F.coalesce(F.col("named") | ((F.col("source_format") == "pdf") & F.col("opened")), F.lit(False)))
    return joined.select("project_id", flag.alias("is_paper"))


def given_in_translation(paragraphs: DataFrame, chapters: DataFrame, rows: int = 10) -> DataFrame:
    """project_id of the books whose first chapter's first rows have translations, all equal to their originals."""
    first = chapters.groupBy("project_id").agg(F.min_by("chapter_id", F.struct("chapter_order", "chapter_id")).alias("chapter_id"))
    w = Window.partitionBy("project_id").orderBy("para_index", "para_id")
    head = paragraphs.join(first, ["project_id", "chapter_id"], "left_semi").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= rows)
    said = head.filter(F.length(F.coalesce("translated_text", F.lit(""))) > 0)
    return said.groupBy("project_id").agg(F.every(F.coalesce(F.col("original_text") == F.col("translated_text"), F.lit(False))).alias("_same")).filter("_same").select("project_id")


def output_titles(projects: DataFrame, same: DataFrame, bilingual: bool = False) -> DataFrame:
    """The title of an export: bilingual, of a Vietnamese original (by type, title, author, or ``same`` texts), or translated."""
    rows = projects.join(same.select("project_id", F.lit(True).alias("_same")), "project_id", "left")
    original = (F.col("document_type") == "textbook") | F.lower("title").contains("giáo trình") | F.lower("author").contains("bộ giáo dục") | F.coalesce("_same", F.lit(False))
    title = F.concat("title", F.lit(" (Song Ngữ Anh - Việt)")) if bilingual else F.when(F.coalesce(original, F.lit(False)), F.col("title")).otherwise(F.concat("title", F.lit(" (Bản Dịch Tiếng Việt)")))
    return rows.select("project_id", title.alias("output_title"))


#: Phrases of licences and permissions; fixed values.
BOILERPLATE = (
    "proper attribution is provided", "permission to make digital or hard copies", "reproduce the tables and figures in this paper solely for use in journalistic",
    "this work is licensed under a creative commons", "copyright held by the owner/author",
)


def without_boilerplate(paragraphs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Rows without those of a first chapter that hold a licence phrase, and without blank ones."""
    first = chapters.filter("chapter_order = 0").select("project_id", "chapter_id", F.lit(True).alias("_first"))
    text = F.coalesce(F.lower("original_text"), F.lit(""))
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase |= text.contains(p)
    rows = paragraphs.join(first, ["project_id", "chapter_id"], "left")
    return rows.filter(~(F.coalesce("_first", F.lit(False)) & phrase) & (F.length(strip(text)) > 0)).drop("_first")


#: Verbs of speech and words that are no names; fixed values.
SPEECH_VERBS = "said|asked|replied|whispered|shouted|muttered|cried|sighed|nodded|gasped|yelled|grunted|called|answered"
NO_NAMES = ("He", "She", "It", "They", "The", "One", "Someone", "Nobody", "Who", "What", "Then", "There")


def first_chapters(paragraphs: DataFrame, chapters: DataFrame, n: int = 8) -> DataFrame:
    """Rows of each book's first ``n`` chapters, with the chapter's place: where names are looked for."""
    w = Window.partitionBy("project_id").orderBy("chapter_order", "chapter_id")
    kept = chapters.withColumn("chapter_place", F.row_number().over(w)).filter(F.col("chapter_place") <= n)
    return paragraphs.join(kept.select("project_id", "chapter_id", "chapter_place"), ["project_id", "chapter_id"])


def name_hits(paragraphs: DataFrame) -> DataFrame:
    """Words of 3 to 16 letters after (side 0) or before (1) a verb of speech, one row a hit, capitalised, with its place in the row."""
    after = F.regexp_extract_all("original_text", F.lit(rf"(?i)(?:{SPEECH_VERBS})\s+([A-Z][a-z]{{2,15}})"), F.lit(1))
    before = F.regexp_extract_all("original_text", F.lit(rf"(?i)([A-Z][a-z]{{2,15}})\s+(?:{SPEECH_VERBS})"), F.lit(1))
    none = F.array().cast("array<string>")
    place = [c for c in ("chapter_place", "para_index", "row_id") if c in paragraphs.columns]
    each = F.concat(F.transform(F.coalesce(after, none), lambda w, i: F.struct(F.lit(0).alias("side"), i.alias("at"), w.alias("w"))), F.transform(F.coalesce(before, none), lambda w, i: F.struct(F.lit(1).alias("side"), i.alias("at"), w.alias("w"))))
    hits = paragraphs.select("project_id", *place, F.explode(each).alias("h")).select("project_id", *place, "h.*")
    name = F.concat(F.upper(F.substring("w", 1, 1)), F.lower(F.substring("w", 2, 100)))
    return hits.select("project_id", F.struct(*place, "side", "at").alias("place"), name.alias("name")).filter(~F.col("name").isin(*NO_NAMES))


def speaker_names(paragraphs: DataFrame) -> DataFrame:
    return name_hits(paragraphs).groupBy("project_id", "name").agg(F.count("*").alias("hits"), F.min("place").alias("first_seen"))


def top_speakers(names: DataFrame, known: DataFrame, k: int = 12, least: int = 2) -> DataFrame:
    """The k most frequent names of a project (ties: first seen), then those of at least ``least`` hits that the glossary lacks."""
    w = Window.partitionBy("project_id").orderBy(F.desc("hits"), "first_seen")
    top = names.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).filter(F.col("hits") >= least)
    return top.join(known.select(F.lower("name").alias("_k")).distinct(), F.lower("name") == F.col("_k"), "left_anti").select("project_id", "name", "hits")
