"""Queries over stores, assets, metadata, requests and segments, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import books as B
from ..operators import chunks as C
from ..operators import glossary as G
from ..operators import layout as L
from ..operators import sections as S
from ..operators import toc as O
from ..session import table
from . import fixtures as X
from .books import CTX, LATEST, pack_sql, paras, projs, sstrip
from .layouts import ANCHOR, CHARS, LINES, PROMOTE, RESOLVE, SPINE, _any, _starts, mkey
from .registry import register


def _documents_lines(s, d):
    """Lines of the documents; each ninth is a chapter line."""
    each = table(s, d, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return each.withColumn("line", F.when(F.col("pos") % 9 == 0, F.concat(F.lit("Chapter "), (F.col("pos") / 9 + 1).cast("int").cast("string"))).otherwise(F.col("line")))


SEGMENTS = """WITH a AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc, pos::INTEGER AS pos, CASE WHEN pos % 9 = 0 THEN 'Chapter ' || (pos // 9 + 1) ELSE l END AS line, pos % 9 = 0 AS start FROM a),
c AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc ORDER BY pos) AS g FROM b)
SELECT doc, dense_rank() OVER (PARTITION BY doc ORDER BY g) - 1 AS section, row_number() OVER (PARTITION BY doc, g ORDER BY pos) - 1 AS place, pos, line FROM c WHERE NOT start AND trim(line) <> ''"""


def _requests(s, d):
    p = paras(s, d)
    chunks = C.greedy_chunks(B.chunk_candidates(p, False))
    style = F.concat(F.lit("STYLE "), B.project_type(F.col("document_type"), F.col("source_format")))
    blocks = projs(s, d).select("project_id", C.glossary_block(style, F.lit(""), F.lit(""), F.col("author")).alias("block"))
    return C.requests(C.prompt_body(chunks, p), C.chunk_plan(chunks, p), blocks)


def _requests_sql() -> str:
    kind = "CASE WHEN coalesce(document_type, '') <> '' THEN document_type WHEN source_format = 'pdf' THEN 'paper' ELSE 'novel' END"
    return pack_sql(
        1000, 12,
        f""", ctx AS ({CTX}), pj AS (SELECT * FROM projects QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY loaded_at DESC) = 1),
ps AS (SELECT k.project_id, k.chapter_id, chunk_no, arg_min(k.para_id, struct_pack(a := k.para_index, b := k.para_id)) AS para_id, string_agg('[[[P_' || k.para_id || ']]]' || chr(10) || coalesce(original_text, ''), chr(10) || chr(10) ORDER BY k.para_index, k.para_id) AS prompt FROM packed k JOIN lp USING (project_id, chapter_id, para_id) GROUP BY ALL)
SELECT ps.project_id, ps.chapter_id, chunk_no, concat_ws(chr(10), 'STYLE ' || {kind}, nullif(author, '')) || chr(10) || chr(10) || CASE WHEN coalesce(context_text, '') <> '' THEN '{C.CONTEXT_HEADING}' || chr(10) || context_text || chr(10) || chr(10) ELSE '' END || '{C.ROWS_HEADING}' || chr(10) || prompt AS request
FROM ps JOIN ctx USING (project_id, chapter_id, para_id) JOIN pj USING (project_id)""",
    )


def _pages_text(s, d, done: bool):
    rows = paras(s, d).filter("para_index is not null").select("project_id", F.col("para_index").alias("page"), F.col("translated_text").alias("text"), "status")
    return rows.filter("status = 'done'" if done else "coalesce(status, '') != 'done'").drop("status")


def _cache(s, d):
    return B.cache_appended(_pages_text(s, d, True).filter("length(text) > 0").groupBy("project_id", "page").agg(F.min("text").alias("text")), _pages_text(s, d, False))


def _store_columns(df):
    """One text for the lists of a loaded glossary, so that both engines give the same."""
    people = F.array_join(F.transform("characters", lambda c: F.concat_ws(":", c["name"], c["gender"], c["role"], c["first_person"], c["second_person"], c["third_person"], c["notes"])), "|")
    words = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["source_term"], t["target_term"], t["category"], t["description"])), "|")
    return df.select("project_id", "tone", "custom_instructions", people.alias("characters"), words.alias("terms"))


def _store_sql() -> str:
    def parts(name: str, fields: dict[str, str]) -> str:
        each = ", ".join(f"coalesce(json_extract_string(x, '$.{k}'), '{v}')" for k, v in fields.items())
        return f"coalesce((SELECT string_agg(concat_ws(':', {each}), '|' ORDER BY i) FROM (SELECT unnest(CASE WHEN json_valid(store) THEN json_extract(store, '$.{name}[*]') ELSE [] END) AS x, generate_subscripts(CASE WHEN json_valid(store) THEN json_extract(store, '$.{name}[*]') ELSE [] END, 1) AS i)), '')"

    own = "CASE WHEN json_valid(store) THEN json_extract_string(store, '$.{}') END"
    people = {"name": "", "gender": "unknown", "role": "", "first_person": "tôi", "second_person": "cậu", "third_person": "", "notes": ""}
    words = {"source_term": "", "target_term": "", "category": "general", "description": ""}
    return f"WITH {X.STORES.sql} SELECT project_id, coalesce({own.format('tone')}, 'novel') AS tone, coalesce({own.format('custom_instructions')}, '') AS custom_instructions, {parts('characters', people)} AS characters, {parts('terms', words)} AS terms FROM stores"


def register_all() -> None:
    def lit(name, fn, sql):
        register(name, lambda s, d: fn(s), sql)

    register("section_segment", lambda s, d: S.segments(_documents_lines(s, d), F.col("pos") % 9 == 0), SEGMENTS)
    register("chunk_request", _requests, _requests_sql())
    register("force_restart", lambda s, d: B.restarted(paras(s, d)).select("row_id", "status", "translated_text"), f"WITH {LATEST} SELECT row_id, 'pending' AS status, '' AS translated_text FROM lp")
    text = sstrip("translated_text")
    register(
        "ocr_cache_append", _cache,
        f"WITH {LATEST}, c AS (SELECT project_id, para_index AS page, min(translated_text) AS text FROM lp WHERE para_index IS NOT NULL AND status = 'done' AND length(translated_text) > 0 GROUP BY ALL), n AS (SELECT project_id, para_index AS page, min(translated_text) AS text FROM lp WHERE para_index IS NOT NULL AND coalesce(status, '') <> 'done' AND length({text}) > 0 GROUP BY ALL) SELECT * FROM c UNION ALL SELECT n.* FROM n ANTI JOIN c USING (project_id, page)",
    )
    inner = "trim(regexp_replace(f, '^\\$+|\\$+$', '', 'g'))"
    image = f"'<img class=\"math-' || CASE WHEN starts_with(f, '$$') THEN 'block' ELSE 'inline' END || '\" src=\"images/math_' || substring(md5({inner} || '_250'), 1, 12) || '.png\" alt=\"' || replace(replace(replace(replace(replace({inner}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '\"/>'"
    lit(
        "math_epub", lambda s: X.FORMULAS.df(s).select("row_no", T.math_epub(F.col("text")).alias("html")),
        f"WITH RECURSIVE {X.FORMULAS.sql}, a AS (SELECT row_no, text, coalesce(list_distinct(regexp_extract_all(text, '{T.FORMULA}')), []) AS fs FROM formulas_), b AS (SELECT row_no, text, list_reverse_sort(list_transform(fs, lambda f: struct_pack(n := length(f), f := f))) AS fs FROM a), w AS (SELECT row_no, text, fs, 0 AS i FROM b UNION ALL SELECT row_no, replace(text, f, {image}), fs, i + 1 FROM (SELECT *, fs[i + 1].f AS f FROM w WHERE i < len(fs))) SELECT row_no, text AS html FROM w WHERE i = len(fs)",
    )

    t = f"WITH RECURSIVE {X.TOC.sql}, {X.SPINE.sql}, {X.ELEMENTS.sql}, {SPINE}, {PROMOTE}"
    lit("toc_flatten", lambda s: O.flattened(X.TOC.df(s)), f"WITH RECURSIVE {X.TOC.sql}, fl AS (SELECT doc_id, toc_pos, title, 0 AS depth, [toc_pos] AS way FROM toc WHERE parent_pos IS NULL UNION ALL SELECT c.doc_id, c.toc_pos, c.title, fl.depth + 1, list_append(way, c.toc_pos) FROM toc c JOIN fl ON c.doc_id = fl.doc_id AND c.parent_pos = fl.toc_pos) SELECT doc_id, toc_pos, title, depth, row_number() OVER (PARTITION BY doc_id ORDER BY way) AS place FROM fl")
    lit("toc_intervals", lambda s: O.intervals(_starts(s)), f"{t}, {RESOLVE}, {ANCHOR} SELECT doc_id, toc_pos, title, spine_idx, el_pos, lead(spine_idx) OVER w AS end_spine_idx, lead(el_pos) OVER w AS end_el_pos FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY spine_idx, el_pos)")
    lit("epub_cover", lambda s: O.covers(X.ASSETS.df(s)), f"WITH {X.ASSETS.sql} SELECT doc_id, arg_min(name, pos) AS cover FROM assets WHERE is_image AND (contains(lower(name), 'cover') OR contains(lower(name), 'front')) GROUP BY doc_id")
    lit("archive_documents", lambda s: O.suffix_matches(X.MEMBERS.df(s), X.DOCS.df(s)), f"WITH {X.MEMBERS.sql}, {X.DOCS.sql} SELECT doc_id, member, name FROM members JOIN docs USING (doc_id) WHERE member = name OR ends_with(member, '/' || name) QUALIFY row_number() OVER (PARTITION BY doc_id, member ORDER BY length(name) DESC) = 1")
    w = f"WITH {X.SPANS.sql}, {LINES}"
    lit(
        "pdf_find_line", lambda s: L.find_lines(X.ASKED.df(s), X.SPANS.df(s)),
        f"{w}, {X.ASKED.sql}, j AS (SELECT a.doc, a.page, ask_no, line_no, {mkey('ln.text')} AS key, {mkey('a.text')} AS want, coalesce(abs(ln.x0 - a.x0) + abs(ln.y0 - a.y0), 0.0) AS near FROM asked a JOIN ln ON a.doc = ln.doc AND a.page = ln.page) SELECT doc, page, ask_no, line_no FROM j WHERE contains(key, want) OR contains(want, key) QUALIFY row_number() OVER (PARTITION BY doc, page, ask_no ORDER BY key <> want, near, line_no) = 1",
    )
    area = "greatest(0.0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0.0, least(b.y1, r.y1) - greatest(b.y0, r.y0))"
    lit("pdf_table_union", lambda s: L.table_regions(X.RULED.df(s), X.CAPTIONED.df(s)), f"WITH {X.RULED.sql}, {X.CAPTIONED.sql} SELECT *, 'ruled' AS origin FROM ruled UNION ALL SELECT *, 'caption' FROM captioned b WHERE NOT EXISTS (SELECT 1 FROM ruled r WHERE r.doc = b.doc AND r.page = b.page AND {area} > 0)")
    lit(
        "metadata_accept", lambda s: X.METADATA.df(s).select("file_name", R.accepted_title(F.col("title")).alias("title"), R.accepted_author(F.col("author")).alias("author")),
        f"WITH {X.METADATA.sql} SELECT file_name, CASE WHEN length(trim(coalesce(title, ''))) > 4 AND NOT {_any('lower(title)', R.NO_TITLES)} THEN trim(title) ELSE '' END AS title, CASE WHEN length(trim(coalesce(author, ''))) > 2 AND NOT {_any('lower(author)', R.NO_AUTHORS)} THEN trim(author) ELSE '' END AS author FROM metadata",
    )
    cased = "list_aggregate(list_transform(string_split(lower(c), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ')"
    lit(
        "textbook_metadata", lambda s: X.METADATA.df(s).withColumn("title", R.textbook_title(F.col("title"), F.col("file_name"))).select("file_name", "title", R.textbook_author(F.col("author"), F.col("title")).alias("author")),
        f"WITH {X.METADATA.sql}, a AS (SELECT *, coalesce(nullif(trim(regexp_extract(file_name, '{R.TEXTBOOK_NAME.replace('(?iu)', '(?i)')}', 1)), ''), file_name) AS c FROM metadata), b AS (SELECT file_name, author AS au, coalesce(nullif(trim(title), ''), CASE WHEN upper(c) = c AND lower(c) <> c THEN {cased} ELSE c END) AS title FROM a) SELECT file_name, title, coalesce(nullif(trim(au), ''), CASE WHEN {_any('lower(title)', R.STATE_TITLES)} THEN '{R.STATE_AUTHOR}' ELSE '{R.SEVERAL_AUTHORS}' END) AS author FROM b",
    )
    lit("glossary_store_roundtrip", lambda s: _store_columns(G.loaded(G.stored(G.loaded(X.STORES.df(s))))), _store_sql())
    lit("glossary_lookup", lambda s: G.lookup(X.ASKED_NAMES.df(s), X.CHARACTERS.df(s)), f"WITH {X.CHARACTERS.sql}, {X.ASKED_NAMES.sql}, {CHARS} SELECT n.project_id, n.name, cr.c.name AS character, cr.c.first, cr.c.second, cr.c.third FROM asked_names n LEFT JOIN cr ON cr.project_id = n.project_id AND cr.key = lower(trim(n.name))")
