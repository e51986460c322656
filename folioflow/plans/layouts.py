"""Queries over literal layouts, contents and rules, and over job events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T
from ..operators import books as B
from ..operators import chunks as C
from ..operators import events as E
from ..operators import glossary as G
from ..operators import layout as L
from ..operators import sections as S
from ..operators import toc as O
from ..session import table
from . import fixtures as X
from .books import LATEST, PROJECTS, paras, projs, ssqueeze, sstrip
from .registry import register

LINES = """ln AS (SELECT doc, page, line_no, string_agg(text, '' ORDER BY x0, text) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  sum(size * length(text)) / sum(length(text)) AS size, sum(length(text) * bold::INT) > sum(length(text)) * 0.5 AS bold FROM spans GROUP BY doc, page, line_no)"""
BODY = """lg AS (SELECT doc, page, line_no FROM ln WHERE length(text) >= 40),
bs AS (SELECT doc, size, sum(length(text)) AS n, min(page * 1000000 + line_no * 1000 + x0) AS f FROM spans JOIN lg USING (doc, page, line_no) GROUP BY doc, size),
bb AS (SELECT doc, size FROM bs QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, f) = 1),
body AS (SELECT d.doc, coalesce(bb.size, 10.0) AS body_size FROM (SELECT DISTINCT doc FROM spans) d LEFT JOIN bb USING (doc))"""


def key(c: str) -> str:
    return f"trim(regexp_replace(lower({ssqueeze(c)}), '{T.LEADING_NUMBER}', ''))"


def mkey(c: str) -> str:
    return f"trim(lower({ssqueeze(c)}))"


SIZED = "ls AS (SELECT ln.*, coalesce(ps.width, 612.0) AS width, coalesce(ps.height, 792.0) AS height FROM ln LEFT JOIN page_sizes ps USING (doc, page))"
MARGIN = f"""{SIZED}, mz AS (SELECT doc, page, line_no, {mkey('text')} AS key FROM ls WHERE (y0 < 80 OR y0 > height - 60) AND y1 - y0 < 25),
mt AS (SELECT doc, key, count(DISTINCT page) AS pages FROM mz WHERE length(key) >= 2 GROUP BY ALL HAVING count(DISTINCT page) >= 2),
rl AS (SELECT doc, page, line_no FROM mz WHERE regexp_matches(key, '^\\d{{1,4}}$') OR (doc, key) IN (SELECT doc, key FROM mt))"""


def _headings_sql() -> str:
    names = ", ".join(f"'{n}'" for n in T.SECTION_NAMES)
    t = "trim(text)"
    prose = f"(length({t}) > 120 OR regexp_matches({t}, '[.,;!?]$'))"
    return f"""WITH {X.SPANS.sql}, {X.OUTLINE.sql}, {X.PAGE_SIZES.sql}, {LINES}, {BODY}, {MARGIN},
oc AS (SELECT l.doc, l.page, l.line_no, o.level, CASE WHEN o.page = l.page THEN 0 WHEN o.page = l.page - 1 THEN 1 ELSE 2 END AS r, o.pos FROM ln l JOIN outline o ON l.doc = o.doc AND {key('l.text')} = {key('o.title')} AND abs(o.page - l.page) <= 1 WHERE {key('l.text')} <> ''),
ol AS (SELECT doc, page, line_no, level AS outline_level FROM oc QUALIFY row_number() OVER (PARTITION BY doc, page, line_no ORDER BY r, pos) = 1),
nb AS (SELECT a.doc, a.page, a.line_no, a.y0, a.y1, max(CASE WHEN b.y1 < a.y0 + 5 THEN b.y1 END) AS up, min(CASE WHEN b.y0 > a.y1 - 5 THEN b.y0 END) AS down
  FROM ln a LEFT JOIN ln b ON a.doc = b.doc AND a.page = b.page AND a.line_no <> b.line_no AND abs((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2) <= 40 GROUP BY ALL),
iso AS (SELECT doc, page, line_no, coalesce(y0 - up > body_size * 1.3 * 0.5, true) AND coalesce(down - y1 > body_size * 1.3 * 0.5, true) AS isolated FROM nb JOIN body USING (doc)),
j AS (SELECT ln.*, outline_level, isolated, body_size, (doc, page, line_no) IN (SELECT doc, page, line_no FROM rl) AS running, size / body_size AS ratio FROM ln LEFT JOIN ol USING (doc, page, line_no) JOIN iso USING (doc, page, line_no) JOIN body USING (doc)),
k AS (SELECT *, ({key('text')} IN ({names}) OR regexp_matches({key('text')}, '^appendix\\s+[a-z0-9]')) AS named, {prose} AS prose, length({t}) AS n,
  CASE WHEN ratio >= 1.35 THEN CASE WHEN bold OR ratio >= 1.6 THEN 1 ELSE 2 END WHEN ratio >= 1.1 AND bold THEN 1 WHEN ratio >= 0.95 AND bold AND length({t}) < 80 AND NOT {prose} THEN 2 END AS typo, bold OR ratio > 1.10 AS signal FROM j),
m AS (SELECT *, regexp_matches({t}, '{T.SUBSECTION}') AND NOT (regexp_matches({t}, '{T.LIST_SENTENCE}') AND n > 60) AND n < 80 AS sub FROM k)
SELECT doc, page, line_no, text, (CASE WHEN n < 2 OR regexp_matches({t}, '{T.TOC_LINE}') OR running OR (n > 120 AND NOT named) THEN 0
 WHEN outline_level IS NOT NULL AND NOT prose THEN CASE WHEN outline_level = 1 THEN 1 ELSE 2 END
 WHEN sub AND typo IS NOT NULL THEN greatest(2, typo) WHEN sub AND ((signal AND isolated) OR named) THEN 2
 WHEN regexp_matches({t}, '(?i){T.CHAPTER}') AND n < 100 THEN 1 WHEN named AND NOT prose AND NOT regexp_matches({t}, '{T.SUBSECTION}') THEN 1
 WHEN regexp_matches({t}, '{T.NUMBERED}') AND n < 75 THEN CASE WHEN named OR signal THEN 1 ELSE 0 END
 WHEN regexp_matches({t}, '{T.ROMAN}') AND n < 80 AND (named OR signal OR isolated) THEN 1
 WHEN typo IS NOT NULL AND NOT prose AND n < 80 AND isolated AND (ratio > 1.15 OR (bold AND ratio >= 1)) THEN CASE WHEN typo <= 1 AND ratio > 1.25 THEN 1 ELSE 2 END ELSE 0 END)::BIGINT AS level FROM m"""


def _href_sql() -> str:
    """Dot segments by a recursive walk over the parts."""
    return f"""WITH RECURSIVE {X.HREFS.sql}, u AS (SELECT href, replace(url_decode(replace(href, '+', '%2B')), '\\', '/') AS h FROM hrefs),
p AS (SELECT href, h, list_filter(string_split(split_part(h, '#', 1), '/'), lambda s: s <> '' AND s <> '.') AS parts FROM u),
w AS (SELECT href, h, parts, 0 AS i, []::VARCHAR[] AS acc FROM p UNION ALL
  SELECT href, h, parts, i + 1, CASE WHEN parts[i + 1] = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[1:len(acc) - 1] ELSE list_append(acc, parts[i + 1]) END FROM w WHERE i < len(parts))
SELECT href, array_to_string(acc, '/') AS path, regexp_replace(h, '^[^#]*#?', '') AS fragment FROM w WHERE i = len(parts)"""


SPINE = """rs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spine_pos) - 1 AS spine_idx FROM spine WHERE path IS NOT NULL AND coalesce(linear, 'yes') <> 'no' AND NOT coalesce(is_nav, false))"""
PROMOTE = f"""fc AS (SELECT doc_id, parent_pos AS toc_pos, arg_min(path, toc_pos) AS child_path, count(*) AS children FROM toc WHERE parent_pos IS NOT NULL GROUP BY ALL),
nd AS (SELECT toc.*, coalesce(coalesce(children, 0) > 0 AND (coalesce(path, '') IN ('', '.') OR (regexp_matches(title, '(?i)^(?:part|book|volume|phần|quyển)(?:[^\\p{{L}}\\p{{N}}_]|$)') AND coalesce(child_path, '') <> '' AND path = child_path)), false) AS grouping_ FROM toc LEFT JOIN fc USING (doc_id, toc_pos)),
lv AS (SELECT doc_id, toc_pos, title, path, fragment, grouping_ FROM nd WHERE parent_pos IS NULL UNION ALL SELECT n.doc_id, n.toc_pos, n.title, n.path, n.fragment, n.grouping_ FROM nd n JOIN lv ON n.doc_id = lv.doc_id AND n.parent_pos = lv.toc_pos WHERE lv.grouping_),
pm AS (SELECT doc_id, toc_pos, title, path, fragment FROM lv WHERE NOT grouping_)"""
RESOLVE = """ob AS (SELECT doc_id, string_split(path, '/')[-1] AS base, min(spine_idx) AS base_idx FROM rs GROUP BY ALL HAVING count(*) = 1),
rw AS (SELECT doc_id, toc_pos, list_filter(string_split(coalesce(path, ''), '/'), lambda x: x NOT IN ('', '.')) AS ps, 0 AS i, []::VARCHAR[] AS acc FROM pm UNION ALL
  SELECT doc_id, toc_pos, ps, i + 1, CASE WHEN ps[i + 1] = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[1:len(acc) - 1] ELSE list_append(acc, ps[i + 1]) END FROM rw WHERE i < len(ps)),
rp AS (SELECT doc_id, toc_pos, array_to_string(acc, '/') AS plain FROM rw WHERE i = len(ps)),
rv AS (SELECT pm.doc_id, toc_pos, title, pm.path, fragment, coalesce(rs.spine_idx, ob.base_idx, r2.spine_idx) AS spine_idx FROM pm JOIN rp USING (doc_id, toc_pos) LEFT JOIN rs ON rs.doc_id = pm.doc_id AND rs.path = pm.path LEFT JOIN ob ON ob.doc_id = pm.doc_id AND ob.base = string_split(coalesce(pm.path, ''), '/')[-1] LEFT JOIN rs r2 ON r2.doc_id = pm.doc_id AND r2.path = rp.plain)"""
ANCHOR = """el AS (SELECT e.*, rs.spine_idx FROM elements e JOIN rs ON rs.doc_id = e.doc_id AND rs.path = e.path),
an AS (SELECT doc_id, spine_idx, anchor AS fragment, min(el_pos) AS anchor_pos FROM el WHERE anchor IS NOT NULL GROUP BY ALL),
st0 AS (SELECT r.doc_id, r.toc_pos, r.title, r.spine_idx, coalesce(min(CASE WHEN el.el_pos >= an.anchor_pos THEN el.el_pos END), 0) AS el_pos FROM rv r LEFT JOIN an ON an.doc_id = r.doc_id AND an.spine_idx = r.spine_idx AND an.fragment = r.fragment LEFT JOIN el ON el.doc_id = r.doc_id AND el.spine_idx = r.spine_idx AND trim(coalesce(el.text, '')) <> '' WHERE r.spine_idx IS NOT NULL GROUP BY ALL),
st AS (SELECT * FROM st0 QUALIFY row_number() OVER (PARTITION BY doc_id, spine_idx, el_pos ORDER BY toc_pos) = 1)"""


def _spine(s):
    return O.reading_spine(X.SPINE.df(s))


def _resolved(s):
    return O.resolved(O.promoted(X.TOC.df(s)), _spine(s))


def _starts(s):
    return O.anchored(_resolved(s), _spine(s), X.ELEMENTS.df(s))


def _textbook_sql() -> str:
    chap, major, roman, sub, alone = (p.replace("(?iu)", "(?i)") for p in (S.CHAPTER_LINE, S.MAJOR, S.ROMAN, S.SUB, S.ALONE))
    return f"""WITH {X.TEXTBOOK.sql}, a AS (SELECT doc, pos, trim(line) AS line, lead(trim(line)) OVER (PARTITION BY doc ORDER BY pos) AS nx FROM textbook),
b AS (SELECT *, regexp_matches(line, '{alone}') AND coalesce(nx, '') <> '' AND NOT regexp_matches(coalesce(nx, '#'), '^(?:#|A\\.|B\\.|C\\.|I-|II-)') AS takes FROM a),
c AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc ORDER BY pos), false) AS taken FROM b),
d AS (SELECT doc, pos, CASE WHEN takes THEN regexp_extract(line, '{alone}', 1) || ': ' || nx ELSE line END AS line FROM c WHERE NOT taken),
e AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '{chap}') THEN 'chapter' WHEN regexp_matches(line, '{major}') THEN 'h2' WHEN regexp_matches(line, '{roman}') THEN 'h3' WHEN regexp_matches(line, '{sub}') THEN 'h4' WHEN starts_with(line, '>') THEN 'blockquote' ELSE 'p' END AS kind,
  trim(CASE WHEN starts_with(line, '>') THEN regexp_replace(line, '^[> ]+', '') ELSE regexp_replace(line, '^#+\\s*', '') END) AS clean FROM d),
f AS (SELECT *, (kind <> 'p' OR coalesce(lag(kind) OVER (PARTITION BY doc ORDER BY pos), '') <> 'p')::INT AS brk FROM e),
g AS (SELECT *, sum(brk) OVER (PARTITION BY doc ORDER BY pos) AS run, sum((kind = 'chapter')::INT) OVER (PARTITION BY doc ORDER BY pos) AS chapter FROM f),
h AS (SELECT doc, chapter, run, kind, replace(regexp_replace(string_agg(clean, '␟' ORDER BY pos), '-␟', '', 'g'), '␟', ' ') AS text FROM g WHERE kind <> 'blank' GROUP BY ALL)
SELECT doc, chapter::BIGINT AS chapter, row_number() OVER (PARTITION BY doc ORDER BY run) AS place, kind AS tag, text FROM h"""


def _any(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


FRONT = f"""fr AS (SELECT doc, line_no, x0, y0, y1, text, size, CASE WHEN NOT {_any('lower(text)', L.LICENCE_WORDS)} AND y0 < height * 0.4 THEN 'title' WHEN NOT {_any('lower(text)', L.AFFILIATIONS)} AND NOT {_any('lower(text)', L.PLACES)} THEN 'author' ELSE 'none' END AS role
  FROM (SELECT spans.*, coalesce(ps.height, 792.0) AS height FROM spans LEFT JOIN page_sizes ps USING (doc, page)) WHERE page = 0 AND trim(text) <> '' AND NOT (x0 < 35 AND y0 > height * 0.25) AND NOT (y1 < 20 OR y1 > height - 30) AND NOT contains(lower(text), 'arxiv:'))"""

DOCX_SQL = f"""WITH {X.DOCX.sql}, a AS (SELECT *, try_cast(nullif(regexp_extract(style, '^heading ([1-6])$', 1), '') AS INTEGER) AS level FROM docx),
b AS (SELECT *, min(level) OVER (PARTITION BY doc) AS top FROM a),
c AS (SELECT *, (coalesce(level = top, false) OR style = 'title' OR (top IS NULL AND length(trim(text)) < 100 AND regexp_matches(trim(text), '(?i){T.DOCX_CHAPTER}'))) AS start FROM b)
SELECT doc, pos, sum(start::INT) OVER (PARTITION BY doc ORDER BY pos)::BIGINT AS section, CASE WHEN level IS NOT NULL THEN 'h' || level WHEN start THEN 'h1' ELSE 'p' END AS tag, text FROM c"""

CHARS = """cr AS (SELECT project_id, lower(trim(name)) AS key, min(pos) AS place, arg_max(struct_pack(name := trim(name), gender := gender, role := role, first := first, second := second, third := third, notes := notes), pos) AS c FROM characters GROUP BY ALL)"""
TERMS = """tr AS (SELECT project_id, lower(trim(source)) AS key, min(pos) AS place, arg_max(struct_pack(source := trim(source), target := trim(target), description := trim(description)), pos) AS t FROM terms WHERE trim(source) <> '' AND trim(target) <> '' GROUP BY ALL)"""


def _pages(s, d):
    """Pages of pdf books: project_id, page (0-based), text."""
    p = paras(s, d).join(projs(s, d).filter("source_format = 'pdf'").select("project_id"), "project_id", "left_semi")
    return p.select("project_id", (F.col("para_index") - 1).alias("page"), "original_text", "translated_text")


PAGES = f"{LATEST}, {PROJECTS}, pgs AS (SELECT project_id, para_index - 1 AS page, original_text, translated_text FROM lp WHERE project_id IN (SELECT project_id FROM pj WHERE source_format = 'pdf'))"
DISTINCT = "de AS (SELECT * FROM job_events QUALIFY row_number() OVER (PARTITION BY project_id, chapter_id, para_id, level_name, message, event_at ORDER BY received_at, event_id) = 1)"


def events(s, d):
    return E.distinct_events(table(s, d, "job_events"))


def _resolved_replies(s, d):
    return C.resolved_replies(["chunk_id"], X.REPLIES.df(s), X.EXPECTED.df(s))


REPLY_SQL = f"""WITH {X.REPLIES.sql}, {X.EXPECTED.sql},
pt AS (SELECT chunk_id, unnest(string_split(reply, '[[[P_')[2:]) AS part, generate_subscripts(string_split(reply, '[[[P_')[2:], 1) AS pos FROM replies),
mk0 AS (SELECT chunk_id, pos, regexp_extract(part, '^([^\\]]*)\\]\\]\\]', 1) AS para_id, {sstrip("regexp_replace(part, '^[^\\]]*\\]\\]\\]', '')")} AS text FROM pt),
mk AS (SELECT chunk_id, para_id, arg_max(text, pos) AS text FROM mk0 WHERE para_id <> '' AND text <> '' GROUP BY ALL),
ct AS (SELECT r.chunk_id, reply, (SELECT count(*) FROM expected e WHERE e.chunk_id = r.chunk_id) AS want, (SELECT count(*) FROM mk WHERE mk.chunk_id = r.chunk_id) AS have FROM replies r),
bl AS (SELECT chunk_id, want, list_filter(list_transform(regexp_split_to_array(reply, '\\n\\s*\\n'), lambda b: {sstrip("regexp_replace(b, '\\[\\[\\[P_[^\\]]*\\]\\]\\]', '', 'g')")}), lambda b: b <> '') AS b FROM ct WHERE have < want),
fb AS (SELECT chunk_id, unnest(b) AS text, generate_subscripts(b, 1) - 1 AS pos FROM bl WHERE len(b) = want),
al AS (SELECT chunk_id, para_id, text, 'marker' AS method FROM mk UNION ALL SELECT fb.chunk_id, e.para_id, fb.text, 'position' FROM fb JOIN expected e ON e.chunk_id = fb.chunk_id AND e.pos = fb.pos WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.chunk_id = fb.chunk_id AND mk.para_id = e.para_id))
SELECT al.chunk_id, al.para_id, text, method FROM al JOIN expected e ON e.chunk_id = al.chunk_id AND e.para_id = al.para_id"""


def _lit(name, fn, sql):
    register(name, lambda s, d: fn(s), sql)


def register_all() -> None:
    w = f"WITH {X.SPANS.sql}, {X.PAGE_SIZES.sql}, {LINES}"
    _lit("pdf_line_stats", lambda s: L.lines(X.SPANS.df(s)), f"{w} SELECT * FROM ln")
    _lit("pdf_body_font", lambda s: L.body_font(X.SPANS.df(s)), f"{w}, {BODY} SELECT * FROM body")
    _lit("pdf_running_headers", lambda s: L.margin_texts(X.SPANS.df(s), 2, X.PAGE_SIZES.df(s)), f"{w}, {MARGIN} SELECT * FROM mt")
    _lit("pdf_heading_classify", lambda s: L.heading_levels(X.SPANS.df(s), X.OUTLINE.df(s), X.PAGE_SIZES.df(s)), _headings_sql())
    _lit("pdf_running_lines", lambda s: L.running_lines(X.SPANS.df(s), X.PAGE_SIZES.df(s)), f"{w}, {MARGIN} SELECT * FROM rl")
    _lit("pdf_front_spans", lambda s: L.front_spans(X.SPANS.df(s), X.PAGE_SIZES.df(s)), f"{w}, {FRONT} SELECT * FROM fr")
    _lit("pdf_title", lambda s: L.title_of(X.SPANS.df(s), X.PAGE_SIZES.df(s)), f"{w}, {FRONT}, t AS (SELECT *, max(size) OVER (PARTITION BY doc) AS big FROM fr WHERE role = 'title' AND length(trim(text)) > 1) SELECT doc, string_agg(trim(text), ' ' ORDER BY round_even(y0 / 6, 0) * 6, x0, text) AS title FROM t WHERE size >= big - 1.5 GROUP BY doc")
    _lit("pdf_authors", lambda s: L.author_list(X.AUTHORS.df(s)), f"WITH {X.AUTHORS.sql}, f AS (SELECT doc, name, min(pos) AS pos FROM names_ WHERE regexp_matches(name, '^(?:[A-Z][\\p{{L}}.\\-'']+)(?:\\s+[A-Z][\\p{{L}}.\\-'']+){{1,3}}$') GROUP BY ALL), g AS (SELECT doc, list(name ORDER BY pos) AS a FROM f GROUP BY doc) SELECT doc, CASE WHEN len(a) > 6 THEN array_to_string(a[1:5], ', ') || ' and ' || (len(a) - 5) || ' others' ELSE array_to_string(a, ', ') END AS authors FROM g")
    side = "CASE WHEN x1 - x0 > width * 0.62 THEN 'full' WHEN x1 < width / 2 + width * 0.08 THEN 'left' WHEN x0 > width / 2 - width * 0.08 THEN 'right' ELSE 'full' END"
    sized = "bk AS (SELECT blocks.*, coalesce(ps.width, 612.0) AS width, coalesce(ps.height, 792.0) AS height FROM blocks LEFT JOIN page_sizes ps USING (doc, page))"
    _lit(
        "pdf_reading_order", lambda s: L.reading_order(X.BLOCKS.df(s), X.PAGE_SIZES.df(s)),
        f"WITH {X.BLOCKS.sql}, {X.PAGE_SIZES.sql}, {sized}, a AS (SELECT *, {side} AS side FROM bk), b AS (SELECT *, bool_or(side = 'left') OVER p AND bool_or(side = 'right') OVER p AS cols FROM a WINDOW p AS (PARTITION BY doc, page)), c AS (SELECT *, CASE WHEN cols THEN sum((side = 'full')::INT) OVER (PARTITION BY doc, page ORDER BY y0, x0, block_no) * 2 - (side = 'full')::INT ELSE 0 END AS band, CASE WHEN cols AND side = 'right' THEN 1 ELSE 0 END AS rk FROM b) SELECT doc, page, block_no, side, row_number() OVER (PARTITION BY doc, page ORDER BY band, rk, y0, x0, block_no) AS place FROM c",
    )
    _lit("pdf_split_columns", lambda s: L.split_columns(X.BLOCK_LINES.df(s)), f"WITH {X.BLOCK_LINES.sql}, a AS (SELECT *, CASE WHEN x1 <= 306 THEN 'left' WHEN x0 >= 306 THEN 'right' ELSE 'full' END AS side FROM blines), b AS (SELECT *, CASE WHEN bool_and(side <> 'full') OVER k AND bool_or(side = 'left') OVER k AND bool_or(side = 'right') OVER k AND side = 'right' THEN 1 ELSE 0 END AS part FROM a WINDOW k AS (PARTITION BY doc, page, block_no)) SELECT doc, page, block_no, part, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, chr(10) ORDER BY y0, x0, text) AS text FROM b GROUP BY doc, page, block_no, part")
    area = "greatest(0.0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0.0, least(b.y1, r.y1) - greatest(b.y0, r.y0))"
    noise = f"(x0 < 45 AND (y1 - y0 > 120 OR contains(lower(text), 'arxiv:'))) OR (regexp_matches(text, '^\\s*\\d{{1,3}}\\s*$') AND y0 > height - 60) OR (page = 0 AND y0 > height - 120 AND {_any('lower(text)', L.FIRST_PAGE_NOTES)}) OR ({_any('text', L.AXIS_TOKENS)} AND NOT {_any('text', L.AXIS_WORDS)})"
    _lit("pdf_block_exclusion", lambda s: L.outside_regions(L.noise_blocks(X.BLOCKS.df(s), L.margin_texts(X.SPANS.df(s), 2, X.PAGE_SIZES.df(s)), X.PAGE_SIZES.df(s)), X.REGIONS.df(s)), f"{w}, {MARGIN}, {X.BLOCKS.sql}, {X.REGIONS.sql}, {sized} SELECT doc, page, block_no, x0, y0, x1, y1, text FROM bk b WHERE NOT ({noise}) AND NOT ((y0 < 80 OR y0 > height - 60) AND y1 - y0 < 25 AND (doc, {mkey('text')}) IN (SELECT doc, key FROM mt)) AND NOT EXISTS (SELECT 1 FROM regions r WHERE r.doc = b.doc AND r.page = b.page AND CASE WHEN r.kind = 'table' THEN {area} > (b.x1 - b.x0) * (b.y1 - b.y0) * 0.35 ELSE {area} > 0 END)")
    _lit("pdf_caption_match", lambda s: L.caption_regions(X.CAPTIONS.df(s), X.IMAGES.df(s)), f"WITH {X.CAPTIONS.sql}, {X.IMAGES.sql} SELECT doc, page, caption_no, image_no FROM captions JOIN images USING (doc, page) WHERE y1 <= y0 + 1 AND y0 - y1 <= 550 QUALIFY row_number() OVER (PARTITION BY doc, page, caption_no ORDER BY y0 - y1, image_no) = 1")
    _lit("pdf_table_captions", lambda s: L.kth_pairs(X.CAPTIONS.df(s), X.TABLES.df(s)), f"WITH {X.CAPTIONS.sql}, {X.TABLES.sql}, c AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY y0, caption_no) AS k FROM captions), t AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY y0, table_no) AS k FROM tables_) SELECT c.doc, c.page, caption_no, table_no FROM c JOIN t USING (doc, page, k)")
    _lit("bbox_unions", lambda s: L.rule_clusters(X.RULES.df(s)), f"WITH {X.RULES.sql}, a AS (SELECT *, max(y1) OVER (PARTITION BY doc, page, caption_no ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM rules), b AS (SELECT *, sum(coalesce(y0 - up > 60, false)::INT) OVER (PARTITION BY doc, page, caption_no ORDER BY y0, y1) AS g FROM a) SELECT doc, page, caption_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS rules FROM b WHERE g = 0 GROUP BY ALL")
    t = f"WITH RECURSIVE {X.TOC.sql}, {X.SPINE.sql}, {X.ELEMENTS.sql}, {SPINE}, {PROMOTE}"
    _lit("spine_filter", lambda s: _spine(s).select("doc_id", "spine_idx", "path"), f"WITH {X.SPINE.sql}, {SPINE} SELECT doc_id, spine_idx, path FROM rs")
    _lit("toc_promote", lambda s: O.promoted(X.TOC.df(s)), f"{t} SELECT * FROM pm")
    _lit("toc_resolve", _resolved, f"{t}, {RESOLVE} SELECT * FROM rv")
    _lit("toc_anchors", _starts, f"{t}, {RESOLVE}, {ANCHOR} SELECT * FROM st")
    _lit("toc_assign_chapters", lambda s: O.assigned(_starts(s), _spine(s), X.ELEMENTS.df(s)), f"{t}, {RESOLVE}, {ANCHOR}, bo AS (SELECT doc_id, spine_idx, el_pos, title AS start, 0 AS kind, NULL::VARCHAR AS text FROM st UNION ALL SELECT doc_id, spine_idx, el_pos, NULL::VARCHAR, 1, text FROM el), ch AS (SELECT *, coalesce(last_value(start IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY spine_idx, el_pos, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Preamble') AS chapter FROM bo) SELECT doc_id, spine_idx, el_pos, chapter, text FROM ch WHERE kind = 1")
    _lit("href_normalise", lambda s: O.href_parts(X.HREFS.df(s)), _href_sql())
    _lit("textbook_structure", lambda s: S.textbook_rows(X.TEXTBOOK.df(s)), _textbook_sql())
    _lit("docx_sections", lambda s: S.docx_sections(X.DOCX.df(s)), DOCX_SQL)
    _lit("number_line_headings", lambda s: S.number_headings(X.NUMBER_LINES.df(s)), f"WITH {X.NUMBER_LINES.sql}, a AS (SELECT *, lead(line) OVER (PARTITION BY doc, block ORDER BY pos) AS nx FROM nlines) SELECT doc, block, line || ' ' || nx AS heading, (CASE WHEN contains(line, '.') THEN 2 ELSE 1 END)::BIGINT AS level FROM a WHERE regexp_matches(line, '^\\d{{1,2}}(?:\\.\\d{{1,2}})*\\.?$') AND coalesce(regexp_matches(nx, '^[A-Z]'), false)")
    _lit("glossary_resolve", lambda s: G.resolved_characters(X.CHARACTERS.df(s)), f"WITH {X.CHARACTERS.sql}, {CHARS} SELECT project_id, key, place, c.name, c.gender, c.role, c.first, c.second, c.third, c.notes FROM cr")
    _lit("glossary_terms", lambda s: G.resolved_terms(X.TERMS.df(s)), f"WITH {X.TERMS.sql}, {TERMS} SELECT project_id, key, place, t.source, t.target, t.description FROM tr")
    _lit("glossary_prompt", lambda s: G.glossary_lines(X.CHARACTERS.df(s), X.TERMS.df(s)), f"WITH {X.CHARACTERS.sql}, {X.TERMS.sql}, {CHARS}, {TERMS}, l AS (SELECT project_id, 0 AS kind, place, '- ' || c.name || ' (' || c.gender || ', ' || c.role || '): ' || c.first || '/' || c.second || '/' || c.third || CASE WHEN c.notes <> '' THEN '; ' || c.notes ELSE '' END AS line FROM cr UNION ALL SELECT project_id, 1, place, '- ' || t.source || ' -> ' || t.target || CASE WHEN t.description <> '' THEN ' (' || t.description || ')' ELSE '' END FROM tr) SELECT project_id, string_agg(line, chr(10) ORDER BY kind, place) AS block FROM l GROUP BY ALL")
    _lit("glossary_form_parse", lambda s: X.FORMS.df(s).select("text", R.role_parts(F.col("text")).alias("p")).select("text", "p.*"), f"WITH {X.FORMS.sql}, a AS (SELECT text, list_filter(list_transform(regexp_split_to_array(text, '\\s*[-–/,]\\s*'), lambda x: trim(x)), lambda x: x <> '') AS p FROM forms) SELECT text, coalesce(p[1], '') AS role, coalesce(p[2], 'tôi') AS first, coalesce(p[3], 'cậu') AS second FROM a")
    tone = "CASE WHEN document_type = 'paper' THEN 'academic' WHEN document_type = 'novel' AND tone = 'academic' THEN 'novel' WHEN tone IN ('novel', 'academic', 'selfhelp', 'classic', 'fantasy') THEN tone ELSE 'novel' END"
    _lit("tone_normalise", lambda s: X.STYLES.df(s).select("project_id", R.effective_tone(F.col("document_type"), F.col("tone")).alias("tone")), f"WITH {X.STYLES.sql} SELECT project_id, {tone} AS tone FROM styles")
    sheets = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.TONE_SHEETS.items())
    _lit("prompt_tone_lookup", lambda s: X.STYLES.df(s).select("project_id", R.tone_sheet(R.effective_tone(F.col("document_type"), F.col("tone"))).alias("sheet")), f"WITH {X.STYLES.sql} SELECT project_id, CASE {tone} {sheets} END AS sheet FROM styles")
    register("doc_type_infer", lambda s, d: projs(s, d).select("project_id", B.project_type(F.col("document_type"), F.col("source_format")).alias("document_type")), f"WITH {PROJECTS} SELECT project_id, CASE WHEN coalesce(document_type, '') <> '' THEN document_type WHEN source_format = 'pdf' THEN 'paper' ELSE 'novel' END AS document_type FROM pj")
    _lit("export_dispatch", lambda s: X.EXPORTS.df(s).select("*", R.export_kind(F.col("format")).alias("kind"), F.contains(F.lower("format"), F.lit("bilingual")).alias("bilingual"), ((R.export_kind(F.col("format")) == "epub") & (F.col("source_format") == "epub") & F.col("has_source")).alias("in_place")), f"WITH {X.EXPORTS.sql} SELECT *, CASE WHEN contains(lower(format), 'epub') THEN 'epub' WHEN contains(lower(format), 'docx') THEN 'docx' WHEN contains(lower(format), 'html') OR contains(lower(format), 'pdf') THEN 'html' WHEN contains(lower(format), 'txt') THEN 'txt' ELSE 'unknown' END AS kind, contains(lower(format), 'bilingual') AS bilingual, contains(lower(format), 'epub') AND source_format = 'epub' AND has_source AS in_place FROM exports")
    ext = "lower(regexp_extract(file_name, '\\.([A-Za-z0-9]+)$', 1))"
    kind = f"CASE WHEN coalesce(document_type, '') <> '' THEN document_type WHEN {ext} = 'pdf' THEN 'paper' ELSE 'novel' END"
    _lit("ingest_gate", lambda s: X.UPLOADS.df(s).select("file_name", R.upload_verdict(F.col("file_name"), F.col("n_bytes"), F.col("document_type")).alias("verdict")), f"WITH {X.UPLOADS.sql} SELECT file_name, CASE WHEN NOT regexp_matches(file_name, '^[^/\\\\]+$') THEN 'bad_name' WHEN {ext} NOT IN ('epub', 'pdf', 'docx', 'txt', 'md') THEN 'bad_extension' WHEN {kind} = 'textbook' THEN 'bad_type' WHEN ({kind} = 'paper') <> ({ext} = 'pdf') THEN 'incompatible' WHEN n_bytes = 0 THEN 'empty' WHEN n_bytes > 104857600 THEN 'too_large' ELSE 'accepted' END AS verdict FROM uploads")
    _lit("filename_cleanup", lambda s: X.FILES.df(s).select("name", T.clean_file_name(F.col("name")).alias("title"), T.safe_file_name(F.concat(T.clean_file_name(F.col("name")), F.lit(": a/b?"))).alias("safe")), f"WITH {X.FILES.sql}, a AS (SELECT name, trim(replace(regexp_replace(regexp_replace(name, '\\.[A-Za-z0-9]+$', ''), '^[0-9a-f]{{8}}_', ''), '_', ' ')) AS title FROM files) SELECT name, title, trim(regexp_replace(title || ': a/b?', '[^\\p{{L}}\\p{{N}} _\\-]', '', 'g')) AS safe FROM a")
    said = "try_cast(nullif(regexp_extract(message, '(?i)retry in\\s+([0-9.]+)\\s*s', 1), '') AS DOUBLE)"
    model = "coalesce(CASE WHEN provider = 'gemini' THEN CASE model " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.MODEL_ALIASES.items()) + " END END, nullif(model, ''), CASE provider " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.DEFAULT_MODELS.items()) + " END, 'free-fallback')"
    _lit(
        "provider_rules", lambda s: X.PROVIDERS.df(s).select("call_id", R.model_of(F.col("provider"), F.col("model")).alias("model"), R.error_class(F.col("message")).alias("error_class"), R.retry_after(F.col("provider"), F.col("message"), F.col("retry_header")).alias("wait_s")),
        f"WITH {X.PROVIDERS.sql} SELECT call_id, {model} AS model, CASE WHEN {_any('lower(message)', R.DAILY_WORDS)} THEN 'daily' WHEN {_any('lower(message)', R.RATE_WORDS)} THEN 'rate' WHEN message = '' THEN 'none' ELSE 'other' END AS error_class, coalesce({said} + 2, try_cast(retry_header AS DOUBLE) + 2, CASE WHEN provider = 'gemini' THEN 35.0 ELSE 25.0 END)::DOUBLE AS wait_s FROM calls",
    )
    order = "[" + ", ".join(f"'{m}'" for m in R.NEXT_MODELS) + "]"
    _lit("model_candidates", lambda s: X.PROVIDERS.df(s).select("call_id", F.array_join(R.candidate_models(F.col("provider"), F.col("model")), "|").alias("models")), f"WITH {X.PROVIDERS.sql}, m AS (SELECT call_id, provider, {model} AS model FROM calls) SELECT call_id, CASE WHEN provider = 'gemini' THEN array_to_string(list_concat([model], list_filter({order}, lambda x: x <> model)), '|') ELSE model END AS models FROM m")
    _lit("key_lists", lambda s: X.KEYS.df(s).select("account", F.size(R.key_list(F.col("keys"))).cast("long").alias("n"), F.array_join(F.transform(R.key_list(F.col("keys")), R.masked), "|").alias("masked")), f"WITH {X.KEYS.sql}, a AS (SELECT account, list_filter(list_transform(regexp_split_to_array(keys, '[\\r\\n;,]+'), lambda k: trim(k)), lambda k: k <> '') AS k FROM keys_) SELECT account, len(k) AS n, array_to_string(list_transform(k, lambda x: CASE WHEN length(x) <= 8 THEN '****' ELSE x[1:4] || '...' || right(x, 4) END), '|') AS masked FROM a")
    _lit("quota_health", lambda s: R.key_status(X.PROBES.df(s)), f"WITH {X.PROBES.sql} SELECT account, CASE WHEN bool_and(outcome IN ('invalid', 'error', 'other')) THEN 'error' WHEN bool_or(outcome = 'ok') THEN 'ok' WHEN bool_or(outcome = 'daily') THEN 'daily' WHEN bool_or(outcome = 'rpm') THEN 'rpm' ELSE 'warning' END AS status FROM probes GROUP BY ALL")
    register("response_fallback", _resolved_replies, REPLY_SQL)
    # Pages and events of the driver's tables.
    register("scanned_detect", lambda s, d: _pages(s, d).filter("page < 15").groupBy("project_id").agg((F.avg((F.length(F.trim("original_text")) > 60).cast("int")) < 0.2).alias("scanned")), f"WITH {PAGES} SELECT project_id, avg((length(trim(original_text)) > 60)::INT) < 0.2 AS scanned FROM pgs WHERE page < 15 GROUP BY ALL")
    register("ocr_missing_pages", lambda s, d: B.missing_pages(_pages(s, d)), f"WITH {PAGES} SELECT DISTINCT project_id, page FROM pgs WHERE page IS NOT NULL AND (project_id, page) NOT IN (SELECT project_id, page FROM pgs WHERE length(coalesce({sstrip('translated_text')}, '')) > 0)")
    register("resume_plan", lambda s, d: B.chunk_candidates(paras(s, d)).groupBy("project_id", "chapter_id").agg(F.count("*").alias("rows_left"), F.min("para_index").alias("first_index")), f"WITH {LATEST} SELECT project_id, chapter_id, count(*) AS rows_left, min(para_index) AS first_index FROM lp WHERE coalesce(tag <> 'img', true) AND NOT coalesce(status IN ('done', 'edited'), false) GROUP BY ALL")
    cols = ["event_id", "project_id", "chapter_id", "para_id", "level_name", "message"]
    sel = ", ".join(cols)
    register("event_distinct", lambda s, d: events(s, d).select(*cols), f"WITH {DISTINCT} SELECT {sel} FROM de")
    register("event_feed_since", lambda s, d: E.feed_since(events(s, d), "2025-09-01 00:00:00").select(*cols), f"WITH {DISTINCT} SELECT {sel} FROM de WHERE received_at > TIMESTAMP '2025-09-01 00:00:00'")
    register("event_ring_buffer", lambda s, d: E.ring(events(s, d), 100).select(*cols, "place"), f"WITH {DISTINCT} SELECT {sel}, row_number() OVER (PARTITION BY project_id ORDER BY event_at DESC, event_id DESC) AS place FROM de QUALIFY place <= 100")
    register("retention_view", lambda s, d: E.ring(events(s, d).filter("para_id is not null"), 200).select(*cols, "place"), f"WITH {DISTINCT} SELECT {sel}, row_number() OVER (PARTITION BY project_id ORDER BY event_at DESC, event_id DESC) AS place FROM de WHERE para_id IS NOT NULL QUALIFY place <= 200")
    register("job_latest_state", lambda s, d: E.latest_state(events(s, d)), f"WITH {DISTINCT} SELECT project_id, arg_max(message, struct_pack(a := event_at, b := event_id)) AS status_text, arg_max(chapter_id, struct_pack(a := event_at, b := event_id)) AS chapter_id, count(*) AS n_events, count(*) FILTER (coalesce(level_name IN ('warning', 'error'), false)) AS n_problems FROM de GROUP BY ALL")
    register("late_events", lambda s, d: E.late_events(events(s, d)).select("event_id"), f"WITH {DISTINCT} SELECT event_id FROM de WHERE received_at > event_at + INTERVAL 1 DAY")
    register("live_updates", lambda s, d: events(s, d).join(paras(s, d).select("row_id", *B.PARA_KEY), B.PARA_KEY).groupBy("row_id").agg(F.max("event_at").alias("last_event")), f"WITH {DISTINCT}, {LATEST} SELECT row_id, max(event_at) AS last_event FROM de JOIN lp USING (project_id, chapter_id, para_id) GROUP BY row_id")
