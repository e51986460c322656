"""Operators over page layouts: spans, lines, blocks and outlines of PDF pages, one row each.

spans: doc, page, line_no, x0, y0, x1, y1, text, size, bold. blocks: doc, page, block_no, x0, y0, x1, y1, text.
Every theta join carries (doc, page), so it is a hash join with a residual filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.text import is_section_name, looks_like_prose, match_key, squeeze

#: The size of a page whose own is not known.
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def with_sizes(rows: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """rows with the width and height of their pages. sizes: doc, page, width, height."""
    if sizes is None:
        return rows.withColumn("width", F.lit(PAGE_WIDTH)).withColumn("height", F.lit(PAGE_HEIGHT))
    out = rows.join(sizes.select("doc", "page", "width", "height"), ["doc", "page"], "left")
    return out.withColumn("width", F.coalesce("width", F.lit(PAGE_WIDTH))).withColumn("height", F.coalesce("height", F.lit(PAGE_HEIGHT)))


def lines(spans: DataFrame) -> DataFrame:
    """Lines with text, box, mean size weighted by characters, and whether most characters are bold."""
    n = F.length("text")
    piece = F.struct("x0", "text")
    return spans.groupBy("doc", "page", "line_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["text"]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        (F.sum(F.col("size") * n) / F.sum(n)).alias("size"), (F.sum(n * F.col("bold").cast("int")) > F.sum(n) * 0.5).alias("bold"),
    )


def body_font(spans: DataFrame) -> DataFrame:
    """The size that most characters of long lines have; 10 where no line is long; ties go to the first seen."""
    long = lines(spans).filter(F.length("text") >= 40).select("doc", "page", "line_no")
    sizes = spans.join(long, ["doc", "page", "line_no"], "left_semi").groupBy("doc", "size").agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "line_no", "x0")).alias("first"))
    # Equal counts: the smallest first place, so its negated parts are the largest.
    key = F.struct("n", (-F.col("first.page")).alias("p"), (-F.col("first.line_no")).alias("l"), (-F.col("first.x0")).alias("x"))
    best = sizes.groupBy("doc").agg(F.max_by("size", key).alias("body_size"))
    return spans.select("doc").distinct().join(best, "doc", "left").select("doc", F.coalesce("body_size", F.lit(10.0)).alias("body_size"))


def in_margin() -> Column:
    """A low line in the top or the bottom margin of its page."""
    return ((F.col("y0") < 80) | (F.col("y0") > F.col("height") - 60)) & (F.col("y1") - F.col("y0") < 25)


def margin_key(text: Column) -> Column:
    return F.trim(F.lower(squeeze(text)))


def margin_texts(spans: DataFrame, pages: int = 2, sizes: DataFrame | None = None) -> DataFrame:
    """Texts in the top or bottom margin of at least ``pages`` pages: running headers and footers."""
    zone = with_sizes(lines(spans), sizes).filter(in_margin()).withColumn("key", margin_key(F.col("text"))).filter("length(key) >= 2")
    return zone.groupBy("doc", "key").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= pages)


def running_lines(spans: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Lines that are running headers or footers: they lie in a margin, and their text recurs there or is a bare number."""
    zone = with_sizes(lines(spans), sizes).filter(in_margin()).withColumn("key", margin_key(F.col("text")))
    known = margin_texts(spans, 2, sizes).select("doc", "key", F.lit(True).alias("recurs"))
    return zone.join(known, ["doc", "key"], "left").filter(F.col("recurs") | F.col("key").rlike(r"^\d{1,4}$")).select("doc", "page", "line_no")


def reading_order(blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Places of blocks on two-column pages: bands between full-width blocks, left column before right."""
    width = F.col("width")
    mid, tol = width / 2, width * 0.08
    w = F.col("x1") - F.col("x0")
    side = F.when(w > width * 0.62, "full").when(F.col("x1") < mid + tol, "left").when(F.col("x0") > mid - tol, "right").otherwise("full")
    page = Window.partitionBy("doc", "page")
    rows = with_sizes(blocks, sizes).withColumn("side", side).withColumn("columns", F.bool_or(F.col("side") == "left").over(page) & F.bool_or(F.col("side") == "right").over(page))
    ordered = page.orderBy("y0", "x0", "block_no")
    full = (F.col("side") == "full").cast("int")
    rows = rows.withColumn("band", F.sum(full).over(ordered) * 2 - full)
    rank = F.when(~F.col("columns"), F.lit(0)).when(F.col("side") == "right", 1).otherwise(0)
    rows = rows.withColumn("band", F.when(F.col("columns"), F.col("band")).otherwise(0)).withColumn("rank", rank)
    return rows.withColumn("place", F.row_number().over(page.orderBy("band", "rank", "y0", "x0", "block_no")).cast("long")).select("doc", "page", "block_no", "side", "place")


def split_columns(block_lines: DataFrame, width: float = PAGE_WIDTH) -> DataFrame:
    """Blocks that an extractor merged across two columns, taken apart where every line is on one side of the middle.

    block_lines: doc, page, block_no, y0, x0, y1, x1, text (a row a line).
    """
    mid = width / 2
    side = F.when(F.col("x1") <= mid, "left").when(F.col("x0") >= mid, "right").otherwise("full")
    block = Window.partitionBy("doc", "page", "block_no")
    rows = block_lines.withColumn("side", side)
    apart = F.every(F.col("side") != "full").over(block) & F.bool_or(F.col("side") == "left").over(block) & F.bool_or(F.col("side") == "right").over(block)
    rows = rows.withColumn("part", F.when(apart & (F.col("side") == "right"), 1).otherwise(0))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("doc", "page", "block_no", "part").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text"))


def _overlap() -> Column:
    w = F.greatest(F.lit(0.0), F.least(F.col("b.x1"), F.col("r.x1")) - F.greatest(F.col("b.x0"), F.col("r.x0")))
    h = F.greatest(F.lit(0.0), F.least(F.col("b.y1"), F.col("r.y1")) - F.greatest(F.col("b.y0"), F.col("r.y0")))
    return w * h


def outside_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks that are no part of a table (over 35 % of their area) or a figure (any overlap).

    regions: doc, page, kind (table, figure), x0, y0, x1, y1.
    """
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    hit = F.when(F.col("r.kind") == "table", _overlap() > area * 0.35).otherwise(_overlap() > 0)
    return blocks.alias("b").join(regions.alias("r"), (F.col("b.doc") == F.col("r.doc")) & (F.col("b.page") == F.col("r.page")) & hit, "left_anti")


#: Words of blocks that are no text of a paper; fixed values.
FIRST_PAGE_NOTES = ("conference on", "proceedings", "equal contribution", "nips")
AXIS_TOKENS, AXIS_WORDS = ("<EOS>", "<pad>"), ("Figure", "Table", "Visual")


def _any_in(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def noise_blocks(blocks: DataFrame, running: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Blocks without stamps at the left margin, page numbers, notes at the foot of the first page, tokens of axes and running headers.

    running: doc, key (``margin_key``) of texts that recur in margins.
    """
    t, low = F.coalesce("text", F.lit("")), F.lower(F.coalesce("text", F.lit("")))
    stamp = (F.col("x0") < 45) & ((F.col("y1") - F.col("y0") > 120) | low.contains("arxiv:"))
    number = t.rlike(r"^\s*\d{1,3}\s*$") & (F.col("y0") > F.col("height") - 60)
    note = (F.col("page") == 0) & (F.col("y0") > F.col("height") - 120) & _any_in(low, FIRST_PAGE_NOTES)
    axis = _any_in(t, AXIS_TOKENS) & ~_any_in(t, AXIS_WORDS)
    rows = with_sizes(blocks, sizes).filter(~(stamp | number | note | axis))
    if running is not None:
        headers = running.select(F.col("doc").alias("_doc"), F.col("key").alias("_key"))
        hit = (F.col("doc") == F.col("_doc")) & (margin_key(F.col("text")) == F.col("_key")) & in_margin()
        rows = rows.join(headers, hit, "left_anti")
    return rows.select(*blocks.columns)


#: Words of first pages that belong to no title, and of affiliations and places that are no authors; fixed values.
LICENCE_WORDS = ("permission", "attribution", "copyright", "license", "journalistic", "reproduce the tables")
AFFILIATIONS = (
    "university", "institute", "department", "research", "laborator", "college", "school", "center", "centre", "campus", "brain", "technolog", "corporation",
    "inc.", "ltd", "dept", "faculty", "academy", "group", "team", "sciences", "mary", "williamsburg", "virginia", "google", "toronto",
)
PLACES = (
    "usa", "vietnam", "china", "france", "germany", "japan", "canada", "united states", "london", "paris", "california", "new york", "massachusetts",
    "rio de janeiro", "brazil", "beijing", "tokyo", "singapore", "korea", "australia",
)


def front_spans(spans: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Spans of first pages that may be title or authors, with the role that their words leave open (title, author or none).

    Margins, stamps and blank spans are left out; licences are no titles, affiliations and places no authors.
    """
    low = F.lower("text")
    stamp = (F.col("x0") < 35) & (F.col("y0") > F.col("height") * 0.25)
    edge = (F.col("y1") < 20) | (F.col("y1") > F.col("height") - 30)
    rows = with_sizes(spans, sizes).filter((F.col("page") == 0) & (F.trim("text") != "") & ~stamp & ~edge & ~low.contains("arxiv:"))
    role = F.when(~_any_in(low, LICENCE_WORDS) & (F.col("y0") < F.col("height") * 0.4), "title").when(~_any_in(low, AFFILIATIONS) & ~_any_in(low, PLACES), "author").otherwise("none")
    return rows.select("doc", "line_no", "x0", "y0", "y1", "text", "size", role.alias("role"))


def find_lines(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """The line of each asked text (doc, page, ask_no, text, x0, y0): an equal one, else one that holds it or is held; the nearest by place."""
    ls = lines(spans).select("doc", "page", "line_no", margin_key(F.col("text")).alias("key"), F.col("x0").alias("lx"), F.col("y0").alias("ly"))
    a = asked.withColumn("want", margin_key(F.col("text")))
    near = F.abs(F.col("lx") - F.col("x0")) + F.abs(F.col("ly") - F.col("y0"))
    both = a.join(ls, ["doc", "page"]).filter(F.col("key").contains(F.col("want")) | F.col("want").contains(F.col("key")))
    best = F.struct((F.col("key") != F.col("want")).alias("part"), F.coalesce(near, F.lit(0.0)).alias("near"), "line_no")
    return both.groupBy("doc", "page", "ask_no").agg(F.min_by("line_no", best).alias("line_no"))


def table_regions(ruled: DataFrame, captioned: DataFrame) -> DataFrame:
    """Ruled tables and those that only a caption shows: doc, page, x0, y0, x1, y1, origin. One that a ruled table touches is that one."""
    cols = ["doc", "page", "x0", "y0", "x1", "y1"]
    c, r = captioned.alias("b"), ruled.alias("r")
    own = c.join(r, (F.col("b.doc") == F.col("r.doc")) & (F.col("b.page") == F.col("r.page")) & (_overlap() > 0), "left_anti")
    return ruled.select(*cols, F.lit("ruled").alias("origin")).unionByName(own.select(*cols, F.lit("caption").alias("origin")))


def caption_regions(captions: DataFrame, images: DataFrame, reach: float = 550.0) -> DataFrame:
    """The nearest image above each caption within reach.

    captions: doc, page, caption_no, y0; images: doc, page, image_no, y1.
    """
    pairs = captions.join(images, ["doc", "page"]).filter((F.col("y1") <= F.col("y0") + 1) & (F.col("y0") - F.col("y1") <= reach))
    return pairs.groupBy("doc", "page", "caption_no").agg(F.min_by("image_no", F.struct((F.col("y0") - F.col("y1")).alias("gap"), "image_no")).alias("image_no"))


def kth_pairs(captions: DataFrame, tables: DataFrame) -> DataFrame:
    """The k-th table caption of a page takes its k-th table."""
    c = captions.withColumn("k", F.row_number().over(Window.partitionBy("doc", "page").orderBy("y0", "caption_no")))
    t = tables.withColumn("k", F.row_number().over(Window.partitionBy("doc", "page").orderBy("y0", "table_no")))
    return c.select("doc", "page", "k", "caption_no").join(t.select("doc", "page", "k", "table_no"), ["doc", "page", "k"]).select("doc", "page", "caption_no", "table_no")


def rule_clusters(rules: DataFrame, gap: float = 60.0) -> DataFrame:
    """Rules below a caption up to the first vertical gap; their box.

    rules: doc, page, caption_no, x0, y0, x1, y1, sorted by y0.
    """
    w = Window.partitionBy("doc", "page", "caption_no").orderBy("y0", "y1")
    before = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    brk = F.coalesce(F.col("y0") - before > gap, F.lit(False)).cast("int")
    kept = rules.withColumn("_b", brk).withColumn("_g", F.sum("_b").over(w)).filter("_g = 0")
    return kept.groupBy("doc", "page", "caption_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("rules"))


def title_of(spans: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The title: spans within 1.5 points of the largest size in the top 40 % of the first page, in bands of 6 points."""
    top = front_spans(spans, sizes).filter("role = 'title' and length(trim(text)) > 1")
    top = top.withColumn("big", F.max("size").over(Window.partitionBy("doc"))).filter(F.col("size") >= F.col("big") - 1.5)
    key = F.struct((F.bround(F.col("y0") / 6) * 6).alias("band"), "x0", "text")
    return top.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: F.trim(x["text"])), " ").alias("title"))


def author_list(names: DataFrame, shown: int = 5) -> DataFrame:
    """Distinct authors in order; beyond six the first five and the number of the others. names: doc, pos, name."""
    each = names.filter(F.col("name").rlike(r"^(?:[A-Z][\p{L}.\-']+)(?:\s+[A-Z][\p{L}.\-']+){1,3}$"))
    ordered = each.groupBy("doc").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])).alias("a"))
    many = F.concat(F.array_join(F.slice("a", 1, shown), ", "), F.lit(" and "), (F.size("a") - shown).cast("string"), F.lit(" others"))
    return ordered.select("doc", F.when(F.size("a") > shown + 1, many).otherwise(F.array_join("a", ", ")).alias("authors"))


def outline_levels(rows: DataFrame, outline: DataFrame) -> DataFrame:
    """Levels of lines by an outline entry of the same title on their page, the one before, or the one after.

    outline: doc, level, title, page.
    """
    t = rows.select("doc", F.col("page").alias("p"), "line_no", match_key(F.col("text")).alias("k")).filter("k != ''")
    o = outline.select("doc", "level", F.col("page").alias("op"), match_key(F.col("title")).alias("k"), "pos")
    both = t.join(o, ["doc", "k"]).filter(F.abs(F.col("op") - F.col("p")) <= 1)
    rank = F.when(F.col("op") == F.col("p"), 0).when(F.col("op") == F.col("p") - 1, 1).otherwise(2)
    return both.groupBy("doc", F.col("p").alias("page"), "line_no").agg(F.min_by("level", F.struct(rank.alias("r"), "pos")).alias("outline_level"))


def isolated(rows: DataFrame, body: DataFrame, reach: float = 40.0) -> DataFrame:
    """Lines with more room to the nearest lines above and below than half a line of body text."""
    a, b = rows.alias("a"), rows.alias("b")
    mid = F.abs((F.col("b.y0") + F.col("b.y1")) / 2 - (F.col("a.y0") + F.col("a.y1")) / 2)
    near = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.line_no") != F.col("b.line_no")) & (mid <= reach), "left")
    above = F.max(F.when(F.col("b.y1") < F.col("a.y0") + 5, F.col("b.y1")))
    below = F.min(F.when(F.col("b.y0") > F.col("a.y1") - 5, F.col("b.y0")))
    gaps = near.groupBy("a.doc", "a.page", "a.line_no", "a.y0", "a.y1").agg(above.alias("up"), below.alias("down")).join(body, "doc")
    need = F.col("body_size") * 1.3 * 0.5
    alone = F.coalesce(F.col("y0") - F.col("up") > need, F.lit(True)) & F.coalesce(F.col("down") - F.col("y1") > need, F.lit(True))
    return gaps.select("doc", "page", "line_no", alone.alias("isolated"))


def heading_levels(spans: DataFrame, outline: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Level 0 (none), 1 or 2 of each line by place, outline, numbering, names and typography, the first rule that fits."""
    rows = lines(spans)
    body = body_font(spans)
    rows = rows.join(outline_levels(rows, outline), ["doc", "page", "line_no"], "left").join(isolated(rows, body), ["doc", "page", "line_no"]).join(body, "doc")
    rows = rows.join(running_lines(spans, sizes).withColumn("running", F.lit(True)), ["doc", "page", "line_no"], "left")
    t = F.trim("text")
    n, prose = F.length(t), looks_like_prose(t)
    named = is_section_name(t)
    ratio = F.col("size") / F.col("body_size")
    typo = F.when(ratio >= 1.35, F.when(F.col("bold") | (ratio >= 1.6), 1).otherwise(2)).when((ratio >= 1.1) & F.col("bold"), 1).when((ratio >= 0.95) & F.col("bold") & (n < 80) & ~prose, 2)
    signal = F.col("bold") | (ratio > 1.10)
    sub = t.rlike(T.SUBSECTION) & ~(t.rlike(T.LIST_SENTENCE) & (n > 60)) & (n < 80)
    level = (
        F.when((n < 2) | t.rlike(T.TOC_LINE) | F.coalesce("running", F.lit(False)) | ((n > 120) & ~named), 0)
        .when(F.col("outline_level").isNotNull() & ~prose, F.when(F.col("outline_level") == 1, 1).otherwise(2))
        .when(sub & typo.isNotNull(), F.greatest(F.lit(2), typo))
        .when(sub & ((signal & F.col("isolated")) | named), 2)
        .when(t.rlike("(?i)" + T.CHAPTER) & (n < 100), 1)
        .when(named & ~prose & ~t.rlike(T.SUBSECTION), 1)
        .when(t.rlike(T.NUMBERED) & (n < 75), F.when(named | signal, 1).otherwise(0))
        .when(t.rlike(T.ROMAN) & (n < 80) & (named | signal | F.col("isolated")), 1)
        .when(typo.isNotNull() & ~prose & (n < 80) & F.col("isolated") & ((ratio > 1.15) | (F.col("bold") & (ratio >= 1))), F.when((typo <= 1) & (ratio > 1.25), 1).otherwise(2))
        .otherwise(0)
    )
    return rows.select("doc", "page", "line_no", "text", level.cast("long").alias("level"))
