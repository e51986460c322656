"""Queries over the book tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import books as B
from ..operators import chunks as C
from ..session import table
from .registry import register

BLANK = T.BLANK
LATEST = "lp AS (SELECT * FROM paragraphs QUALIFY row_number() OVER (PARTITION BY project_id, chapter_id, para_id ORDER BY loaded_at DESC, row_id DESC) = 1)"
CHAPTERS = "lc AS (SELECT * FROM chapters QUALIFY row_number() OVER (PARTITION BY project_id, chapter_id ORDER BY loaded_at DESC, chapter_row_id DESC) = 1)"
PROJECTS = "pj AS (SELECT * FROM projects QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY loaded_at DESC) = 1)"
NWORDS = f"len(regexp_extract_all(coalesce(original_text, ''), '{T.NOT_BLANK}+'))"


def sstrip(c: str) -> str:
    return f"regexp_replace({c}, '{T.TRIM}', '', 'g')"


def ssqueeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{BLANK}+', ' ', 'g'))"


def eff(t: str = "translated_text", o: str = "original_text") -> str:
    return f"(CASE WHEN length(coalesce({sstrip(t)}, '')) > 0 THEN {sstrip(t)} ELSE {o} END)"


DONE = "coalesce(status IN ('done', 'edited'), false)"
PROGRESS = f"""pg AS (SELECT project_id, chapter_id, count(*) AS total_rows, count(*) FILTER ({DONE}) AS done_rows, sum({NWORDS})::BIGINT AS n_words FROM lp GROUP BY ALL),
pc AS (SELECT *, CASE WHEN total_rows = 0 THEN 100.0 ELSE round_even(done_rows / total_rows * 100, 1) END::DOUBLE AS progress FROM pg)"""


def paras(spark, d):
    return B.current_paragraphs(table(spark, d, "paragraphs"))


def chaps(spark, d):
    return B.current_chapters(table(spark, d, "chapters"))


def projs(spark, d):
    return B.current_projects(table(spark, d, "projects"))


def progress(spark, d):
    return B.chapter_progress(paras(spark, d))


def _explode(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]", -1)).alias("pos", "line"))
    rows = lines.withColumn("line", T.strip(F.col("line"))).filter(F.length("line") >= 2)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long")).withColumn("pos", F.col("pos").cast("long"))


EXPLODE = f"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\f\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS raw, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\f\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) - 1 AS pos FROM documents),
s AS (SELECT doc_id, pos, {sstrip('raw')} AS line FROM l)
SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM s WHERE length(line) >= 2"""


def _replies(spark, d):
    """Replies made of the chunks' own paragraphs, marked as a model would."""
    chunks = B.latest(table(spark, d, "chunks"), ["project_id", "chunk_id"], ["created_at", "chunk_row_id"])
    piece = F.transform("paragraphs", lambda p: F.concat(F.lit("[[[P_"), p["id"], F.lit("]]]\n vi: "), F.coalesce(p["text"], F.lit("")), F.lit(" \n")))
    return chunks.select("project_id", "chapter_id", "chunk_id", F.array_join(piece, "\n").alias("reply"))


REPLIES = """ck AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY project_id, chunk_id ORDER BY created_at DESC, chunk_row_id DESC) = 1),
ce AS (SELECT project_id, chapter_id, chunk_id, unnest(paragraphs) AS p, generate_subscripts(paragraphs, 1) AS pos FROM ck)"""


def _parsed(spark, d):
    return C.parse_reply(["project_id", "chapter_id", "chunk_id"], _replies(spark, d))


PARSED = f"""pr AS (SELECT project_id, chapter_id, chunk_id, p.id AS para_id, arg_max({sstrip("'vi: ' || coalesce(p.text, '')")}, pos) AS text FROM ce GROUP BY ALL)"""


def _merge(spark, d):
    r = _parsed(spark, d).groupBy("project_id", "chapter_id", "para_id").agg(F.max_by("text", "chunk_id").alias("reply"))
    return B.merged(paras(spark, d), r)


def _pack(t, m):
    def run(spark, d):
        return C.greedy_chunks(B.chunk_candidates(paras(spark, d), only_pending=False), t, m).drop("para_index")

    return run


def pack_sql(t: int, m: int, select: str = "SELECT project_id, chapter_id, para_id, n_words, chunk_no FROM packed") -> str:
    return f"""WITH RECURSIVE {LATEST},
cand AS (SELECT project_id, chapter_id, para_id, para_index, {NWORDS}::BIGINT AS n_words, row_number() OVER (PARTITION BY project_id, chapter_id ORDER BY para_index, para_id) AS rn
  FROM lp WHERE coalesce(tag <> 'img', true)),
packed AS (
  SELECT project_id, chapter_id, para_id, para_index, n_words, rn, n_words AS w, 1 AS n, 0::BIGINT AS chunk_no FROM cand WHERE rn = 1
  UNION ALL
  SELECT c.project_id, c.chapter_id, c.para_id, c.para_index, c.n_words, c.rn,
    CASE WHEN p.w + c.n_words > {t} OR p.n >= {m} THEN c.n_words ELSE p.w + c.n_words END,
    CASE WHEN p.w + c.n_words > {t} OR p.n >= {m} THEN 1 ELSE p.n + 1 END,
    p.chunk_no + CASE WHEN p.w + c.n_words > {t} OR p.n >= {m} THEN 1 ELSE 0 END
  FROM packed p JOIN cand c ON p.project_id = c.project_id AND p.chapter_id = c.chapter_id AND c.rn = p.rn + 1)
{select}"""


CTX = f"""SELECT project_id, chapter_id, para_id, array_to_string(list({eff(o="coalesce(original_text, '')")}) OVER (PARTITION BY project_id, chapter_id ORDER BY para_index, para_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), chr(10)) AS context_text FROM lp"""


def _plan(spark, d):
    p = paras(spark, d)
    return C.chunk_plan(C.greedy_chunks(B.chunk_candidates(p, only_pending=False)), p)


def _classify(spark, d):
    p = paras(spark, d).select("row_id", F.explode(F.split("original_text", "\n", -1)).alias("line")).select("row_id", F.trim("line").alias("line"))
    return p.withColumn("level", T.heading_level(F.col("line")).cast("long")).filter("level is not null")


def q(s: str) -> str:
    return s.replace("'", "''")


def _classify_sql() -> str:
    prose = "(length(line) > 120 OR regexp_matches(line, '[.,;!?]$'))"
    key = f"trim(regexp_replace(lower({ssqueeze('line')}), '{T.LEADING_NUMBER}', ''))"

    def rest(p):
        return f"trim(regexp_extract(line, '{p}', 2))"

    def ok(p):
        return f"length({rest(p)}) < 70 AND NOT regexp_matches({rest(p)}, '[.,;!?]$')"

    names = ", ".join(f"'{n}'" for n in T.SECTION_NAMES)
    return f"""WITH {LATEST}, l AS (SELECT row_id, trim(unnest(string_split(original_text, chr(10)))) AS line FROM lp),
c AS (SELECT row_id, line, (CASE WHEN length(line) < 2 THEN NULL WHEN regexp_matches(line, '{T.TOC_LINE}') THEN NULL WHEN length(line) > 90 THEN NULL
  WHEN regexp_matches(line, '{T.LIST_SENTENCE}') AND length(line) > 60 THEN NULL
  WHEN regexp_matches(line, '{T.SUBSECTION}') AND NOT {prose} AND length(line) < 80 AND {ok(T.SUBSECTION)} THEN 2
  WHEN ({key} IN ({names}) OR regexp_matches({key}, '^appendix\\s+[a-z0-9]')) AND NOT {prose} THEN 1
  WHEN regexp_matches(line, '(?i){T.CHAPTER}') THEN 1
  WHEN regexp_matches(line, '{T.NUMBERED}') AND NOT {prose} AND {ok(T.NUMBERED)} THEN 1
  WHEN regexp_matches(line, '{T.ROMAN}') AND NOT {prose} AND length(line) < 80 THEN 1 END)::BIGINT AS level FROM l)
SELECT * FROM c WHERE level IS NOT NULL"""


def _math_sql(docx: bool) -> str:
    def esc(x):
        return x.replace("'", "''")

    def literal(c, rules):
        for a, b in rules:
            c = f"replace({c}, '{esc(a)}', '{esc(b)}')"
        return c

    def regex(c, rules):
        for a, b in rules:
            c = f"regexp_replace({c}, '{esc(a)}', '{esc(b.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}', 'g')"
        return c

    if docx:
        c = regex("replace(t, '\\$', '$')", T.STRUCTURES)
        return f"regexp_replace({literal(c, T.DOCX_SYMBOLS)}, '\\$([^\\$]+)\\$', '\\1', 'g')"
    return "'<span class=\"math-fallback\">' || " + regex(literal("t", T.UNICODE_SYMBOLS), T.STRUCTURES + T.SCRIPTS) + " || '</span>'"


def _formulas(spark, d):
    return paras(spark, d).filter(F.col("original_text").rlike(r"[\\^_=$]|λ")).select("row_id", F.concat("original_text", F.lit(" \\frac{a}{b} \\infty \\in x_{ij}^2 $\\alpha$")).alias("t"))


FORMULAS = f"f AS (SELECT row_id, original_text || ' \\frac{{a}}{{b}} \\infty \\in x_{{ij}}^2 $\\alpha$' AS t FROM lp WHERE regexp_matches(original_text, '[\\\\^_=$]|λ'))"

CAP = "'(?i)" + T.CAPTION + "'"
IS_CAP = f"(coalesce(tag = 'caption', false) OR coalesce(regexp_matches({sstrip('original_text')}, {CAP}), false) OR coalesce(regexp_matches({sstrip('translated_text')}, {CAP}), false))"
IS_TAB = f"(coalesce(regexp_matches({sstrip('original_text')}, '(?i)^(?:Table|Bảng)'), false) OR coalesce(regexp_matches({sstrip('translated_text')}, '(?i)^(?:Table|Bảng)'), false) OR coalesce(contains(lower(para_id), 'tab'), false))"
OUT_TAG = "CASE WHEN lower(tag) IN ('h1','h2','h3','h4','h5','h6','blockquote','li') THEN lower(tag) ELSE 'p' END"
DUP = f"""fr AS (SELECT project_id, chapter_id, arg_min(struct_pack(tag := tag, o := original_text), struct_pack(a := para_index, b := para_id)) AS f FROM lp GROUP BY ALL),
dp AS (SELECT project_id, chapter_id, coalesce(regexp_matches(f.tag, '^h[1-6]$') AND {ssqueeze('f.o')} = {ssqueeze('title')}, false) AS duplicate FROM lc JOIN fr USING (project_id, chapter_id))"""


def _txt_sql(bilingual: bool) -> str:
    shown = eff(o="coalesce(original_text, '')")
    line = f"'[EN] ' || coalesce(original_text, '') || chr(10) || '[VI] ' || {shown} || chr(10)" if bilingual else f"{shown} || chr(10)"
    return f"""WITH {LATEST}, {CHAPTERS}, {PROJECTS}, {DUP},
body AS (SELECT project_id, chapter_id, string_agg({line}, chr(10) ORDER BY para_index, para_id) AS body FROM lp GROUP BY ALL),
part AS (SELECT project_id, chapter_order, chapter_id, (CASE WHEN duplicate THEN '' ELSE chr(10) || chr(10) || '--- ' || coalesce(title, '') || ' ---' || chr(10) || chr(10) END) || body AS part FROM lc JOIN body USING (project_id, chapter_id) JOIN dp USING (project_id, chapter_id)),
whole AS (SELECT project_id, string_agg(part, chr(10) ORDER BY chapter_order, chapter_id) AS body FROM part GROUP BY ALL)
SELECT project_id, '=== ' || title || ' ===' || chr(10) || 'Tác giả: ' || author || chr(10) || repeat('=', 40) || chr(10) || chr(10) || body AS document FROM pj JOIN whole USING (project_id)"""


def _escape_sql(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _text_sections(strict: bool):
    def run(spark, d):
        lines = _explode(spark, d).withColumn("start", T.is_chapter_line(F.col("line"), strict))
        w = Window.partitionBy("doc_id").orderBy("pos")
        secs = lines.withColumn("section", F.sum(F.col("start").cast("int")).over(w))
        return secs.groupBy("doc_id", "section").agg(F.min_by("line", "pos").alias("title"), F.count("*").alias("n_lines")).withColumn("section", F.col("section").cast("long"))

    return run


def _sections_sql(strict: bool) -> str:
    pattern = T.DOCX_CHAPTER if strict else T.TXT_CHAPTER
    return f"""WITH e AS ({EXPLODE}), f AS (SELECT *, (length(line) < 100 AND regexp_matches(line, '(?i){pattern}')) AS start FROM e),
g AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM f)
SELECT doc_id, section::BIGINT AS section, arg_min(line, pos) AS title, count(*) AS n_lines FROM g GROUP BY ALL"""


def _markdown(spark, d):
    """Sections of the strongest heading level of each document; deeper headings keep their tag."""
    lines = _explode(spark, d).withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)))
    lines = lines.withColumn("level", F.when(F.col("level") > 0, F.col("level")))
    whole = Window.partitionBy("doc_id")
    lines = lines.withColumn("top", F.min("level").over(whole))
    start = F.coalesce((F.col("level") == F.col("top")) & (F.length("line") < 100), F.lit(False))
    lines = lines.withColumn("section", F.sum(start.cast("int")).over(whole.orderBy("pos")).cast("long"))
    tag = F.when(start, "h1").when(F.col("level").isNotNull(), F.concat(F.lit("h"), F.col("level"))).otherwise("p")
    return lines.select("doc_id", "pos", "section", tag.alias("tag"), F.regexp_replace("line", r"^#{1,6}\s+", "").alias("text"))


MARKDOWN = f"""WITH e AS ({EXPLODE}), v AS (SELECT *, nullif(length(regexp_extract(line, '^(#{{1,6}})\\s+\\S', 1)), 0) AS level FROM e),
t AS (SELECT *, min(level) OVER (PARTITION BY doc_id) AS top FROM v),
u AS (SELECT *, coalesce(level = top AND length(line) < 100, false) AS start FROM t)
SELECT doc_id, pos, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS section,
  CASE WHEN start THEN 'h1' WHEN level IS NOT NULL THEN 'h' || level ELSE 'p' END AS tag, regexp_replace(line, '^#{{1,6}}\\s+', '') AS text FROM u"""


def _page_paragraphs(spark, d):
    """Paragraphs of the lines of a page: a break after a short line that ends a sentence, or before a new block."""
    p = paras(spark, d).join(projs(spark, d).filter("source_format = 'pdf'").select("project_id"), "project_id", "left_semi")
    lines = p.select("row_id", F.posexplode(F.split("original_text", "\n", -1)).alias("pos", "line")).select("row_id", "pos", F.trim("line").alias("line")).filter("line != ''")
    w = Window.partitionBy("row_id").orderBy("pos")
    page = Window.partitionBy("row_id")
    n = F.length("line")
    mean = F.coalesce(F.avg(F.when((n > 30) & ~F.col("line").rlike("[.:;]$"), n)).over(page), F.lit(80.0))
    block = F.col("line").rlike(r"^(?:•|–|- |\* )") | F.col("line").rlike(r"^\[\d+\]\s+[A-Z]") | F.col("line").rlike(r"(?i)^(?:Figure|Fig\.?|Table)\s*[\d.\-]+[:.]?")
    lines = lines.withColumn("mean", mean).withColumn("block", block)
    ends = F.col("line").rlike(r"(?:[.!?:]|\.\")$") & ((n < F.col("mean") * 0.78) | F.coalesce(F.lead("block").over(w), F.lit(False)))
    lines = lines.withColumn("ends", ends & ~F.col("block"))
    brk = (F.col("block") | F.coalesce(F.lag("ends").over(w), F.lit(False))).cast("int")
    lines = lines.withColumn("para", F.sum(brk).over(w))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "␟")
    out = lines.groupBy("row_id", "para").agg(joined.alias("t"), F.count("*").alias("n_lines"))
    return out.select("row_id", F.col("para").cast("long").alias("para"), "n_lines", F.replace(F.regexp_replace("t", "-␟", ""), F.lit("␟"), F.lit(" ")).alias("text"))


PAGE = f"""WITH {LATEST}, {PROJECTS}, l0 AS (SELECT row_id, unnest(string_split(original_text, chr(10))) AS raw, generate_subscripts(string_split(original_text, chr(10)), 1) AS pos FROM lp WHERE project_id IN (SELECT project_id FROM pj WHERE source_format = 'pdf')),
l AS (SELECT row_id, pos, trim(raw) AS line FROM l0 WHERE trim(raw) <> ''),
m AS (SELECT *, coalesce(avg(CASE WHEN length(line) > 30 AND NOT regexp_matches(line, '[.:;]$') THEN length(line) END) OVER (PARTITION BY row_id), 80.0) AS mean,
  (regexp_matches(line, '^(?:•|–|- |\\* )') OR regexp_matches(line, '^\\[\\d+\\]\\s+[A-Z]') OR regexp_matches(line, '(?i)^(?:Figure|Fig\\.?|Table)\\s*[\\d.\\-]+[:.]?')) AS block FROM l),
n AS (SELECT *, (regexp_matches(line, '(?:[.!?:]|\\.")$') AND (length(line) < mean * 0.78 OR coalesce(lead(block) OVER (PARTITION BY row_id ORDER BY pos), false)) AND NOT block) AS ends FROM m),
k AS (SELECT *, (block OR coalesce(lag(ends) OVER (PARTITION BY row_id ORDER BY pos), false))::INT AS brk FROM n),
g AS (SELECT *, sum(brk) OVER (PARTITION BY row_id ORDER BY pos) AS para FROM k)
SELECT row_id, para::BIGINT AS para, count(*) AS n_lines, replace(regexp_replace(string_agg(line, '␟' ORDER BY pos), '-␟', '', 'g'), '␟', ' ') AS text FROM g GROUP BY row_id, para"""


def _names_known(spark):
    return spark.createDataFrame([("joossa",), ("NEMI",)], "name string")


def _first(spark, d):
    return B.first_chapters(paras(spark, d), chaps(spark, d))


HITS = f"""fc AS (SELECT project_id, chapter_id, row_number() OVER (PARTITION BY project_id ORDER BY chapter_order, chapter_id) AS cp FROM lc QUALIFY cp <= 8),
fr AS (SELECT lp.project_id, original_text, struct_pack(a := cp, b := para_index, c := row_id) AS place FROM lp JOIN fc USING (project_id, chapter_id)),
hits AS (
  SELECT project_id, place, 0 AS side, unnest(regexp_extract_all(original_text, '(?i)(?:{B.SPEECH_VERBS})\\s+([A-Z][a-z]{{2,15}})', 1)) AS w, generate_subscripts(regexp_extract_all(original_text, '(?i)(?:{B.SPEECH_VERBS})\\s+([A-Z][a-z]{{2,15}})', 1), 1) AS nth FROM fr
  UNION ALL SELECT project_id, place, 1, unnest(regexp_extract_all(original_text, '(?i)([A-Z][a-z]{{2,15}})\\s+(?:{B.SPEECH_VERBS})', 1)), generate_subscripts(regexp_extract_all(original_text, '(?i)([A-Z][a-z]{{2,15}})\\s+(?:{B.SPEECH_VERBS})', 1), 1) FROM fr),
nm AS (SELECT project_id, upper(w[1]) || lower(w[2:]) AS name, struct_pack(p := place, s := side, t := nth) AS seen FROM hits),
cn AS (SELECT project_id, name, count(*) AS hits, min(seen) AS seen FROM nm WHERE name NOT IN ({", ".join(f"'{n}'" for n in B.NO_NAMES)}) GROUP BY ALL)"""


def _old(spark, d):
    """Rows with a source document; those of old projects (no document type) have no locator."""
    old = projs(spark, d).filter("coalesce(document_type, '') = ''").select("project_id", F.lit(True).alias("_old"))
    p = paras(spark, d).filter("source_doc is not null").join(old, "project_id", "left")
    return p.withColumn("source_element_index", F.when(F.col("_old"), F.lit(-1)).otherwise(F.col("source_element_index"))).drop("_old")


OLD = f"""od AS (SELECT lp.* REPLACE (CASE WHEN project_id IN (SELECT project_id FROM pj WHERE coalesce(document_type, '') = '') THEN -1 ELSE source_element_index END AS source_element_index) FROM lp WHERE source_doc IS NOT NULL),
tk AS (SELECT project_id, source_doc, source_element_index AS pos FROM od WHERE source_element_index >= 0),
em AS (SELECT project_id, source_doc, source_element_index AS pos, {ssqueeze('original_text')} AS t FROM lp WHERE source_element_index >= 0 AND source_doc IS NOT NULL)"""


def _elements(spark, d):
    p = paras(spark, d)
    return p.filter("source_element_index >= 0 and source_doc is not null").select("project_id", "source_doc", F.col("source_element_index").alias("pos"), F.col("original_text").alias("text"))


def _output_title(s, d):
    same = B.given_in_translation(paras(s, d), chaps(s, d))
    return B.output_titles(projs(s, d), same).join(B.output_titles(projs(s, d), same, True).withColumnRenamed("output_title", "bilingual_title"), "project_id")


SAME = """fs AS (SELECT project_id, arg_min(chapter_id, struct_pack(a := chapter_order, b := chapter_id)) AS chapter_id FROM lc GROUP BY project_id),
hd AS (SELECT lp.project_id, original_text, translated_text FROM lp JOIN fs USING (project_id, chapter_id) QUALIFY row_number() OVER (PARTITION BY lp.project_id ORDER BY para_index, para_id) <= 10),
sm AS (SELECT project_id FROM hd WHERE length(coalesce(translated_text, '')) > 0 GROUP BY project_id HAVING bool_and(coalesce(original_text = translated_text, false)))"""

LICENCE = " OR ".join(f"contains(lower(original_text), '{p}')" for p in B.BOILERPLATE)


def register_all() -> None:
    register("paragraph_explode", _explode, EXPLODE)
    register("paragraph_latest", lambda s, d: paras(s, d).select("row_id", *B.PARA_KEY, "status"), f"WITH {LATEST} SELECT row_id, project_id, chapter_id, para_id, status FROM lp")
    register("word_counts", lambda s, d: progress(s, d).select("project_id", "chapter_id", "n_words"), f"WITH {LATEST}, {PROGRESS} SELECT project_id, chapter_id, n_words FROM pc")
    register("chapter_progress", lambda s, d: progress(s, d), f"WITH {LATEST}, {PROGRESS} SELECT *, CASE WHEN progress >= 100 THEN 'done' WHEN progress > 0 THEN 'progress' ELSE 'pending' END AS badge FROM pc")
    register(
        "project_rollup", lambda s, d: B.project_rollup(progress(s, d)),
        f"WITH {LATEST}, {PROGRESS}, r AS (SELECT project_id, count(*) AS chapters, sum(total_rows)::BIGINT AS total_rows, sum(done_rows)::BIGINT AS done_rows, sum(n_words)::BIGINT AS n_words FROM pc GROUP BY ALL) SELECT *, CASE WHEN total_rows = 0 THEN 0.0 ELSE round_even(done_rows / total_rows * 100, 1) END::DOUBLE AS progress FROM r",
    )
    register(
        "project_listing",
        lambda s, d: projs(s, d).select("project_id", "title", "author", B.project_type(F.col("document_type"), F.col("source_format")).alias("kind"), F.col("updated_at"), F.array_join(F.coalesce("structure_warnings", F.array().cast("array<string>")), "; ").alias("warnings"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("updated_at"), "project_id")).cast("long").alias("place")),
        f"WITH {PROJECTS} SELECT project_id, title, author, CASE WHEN coalesce(document_type, '') <> '' THEN document_type WHEN source_format = 'pdf' THEN 'paper' ELSE 'novel' END AS kind, updated_at, array_to_string(coalesce(structure_warnings, []), '; ') AS warnings, row_number() OVER (ORDER BY updated_at DESC, project_id) AS place FROM pj",
    )
    register("pending_filter", lambda s, d: B.chunk_candidates(paras(s, d)).select("row_id", *B.PARA_KEY), f"WITH {LATEST} SELECT row_id, project_id, chapter_id, para_id FROM lp WHERE coalesce(tag <> 'img', true) AND NOT {DONE}")
    register("chapters_needing_work", lambda s, d: B.needing_work(progress(s, d)).select("project_id", "chapter_id", "progress"), f"WITH {LATEST}, {PROGRESS} SELECT project_id, chapter_id, progress FROM pc WHERE progress < 100")
    register("remaining_rows", lambda s, d: progress(s, d).groupBy("project_id").agg(F.sum(F.col("total_rows") - F.col("done_rows")).alias("remaining")), f"WITH {LATEST}, {PROGRESS} SELECT project_id, sum(total_rows - done_rows)::BIGINT AS remaining FROM pc GROUP BY ALL")
    register("task_percent", lambda s, d: progress(s, d).select("project_id", "chapter_id", F.bround(F.col("done_rows") / F.greatest(F.lit(1), F.col("total_rows")) * 100, 1).alias("percent")), f"WITH {LATEST}, {PROGRESS} SELECT project_id, chapter_id, round_even(done_rows / greatest(1, total_rows) * 100, 1)::DOUBLE AS percent FROM pc")
    register("docs_per_chapter", lambda s, d: paras(s, d).groupBy("project_id", "chapter_id").agg(F.countDistinct("source_doc").alias("docs")), f"WITH {LATEST} SELECT project_id, chapter_id, count(DISTINCT source_doc) AS docs FROM lp GROUP BY ALL")
    register("project_has_text", lambda s, d: paras(s, d).groupBy("project_id").agg(F.coalesce(F.bool_or((F.col("tag") != "img") & (F.length(T.strip(F.col("original_text"))) > 0)), F.lit(False)).alias("has_text")), f"WITH {LATEST} SELECT project_id, coalesce(bool_or(tag <> 'img' AND length({sstrip('original_text')}) > 0), false) AS has_text FROM lp GROUP BY ALL")
    register("meta_projection", lambda s, d: paras(s, d).select("row_id", "para_id", "original_text", "status"), f"WITH {LATEST} SELECT row_id, para_id, original_text, status FROM lp")
    register(
        "chapter_views", lambda s, d: progress(s, d).join(chaps(s, d), ["project_id", "chapter_id"]).select("project_id", "chapter_id", "title", B.chapter_number(F.col("chapter_id")).alias("file_order"), F.dense_rank().over(Window.partitionBy("project_id").orderBy(B.chapter_number(F.col("chapter_id")), "chapter_id")).cast("long").alias("place"), "total_rows", "progress"),
        f"WITH {LATEST}, {CHAPTERS}, {PROGRESS}, v AS (SELECT project_id, chapter_id, title, coalesce(try_cast(nullif(regexp_extract(chapter_id, '_(\\d+)$', 1), '') AS BIGINT), 9999) AS file_order, total_rows, progress FROM pc JOIN lc USING (project_id, chapter_id)) SELECT *, dense_rank() OVER (PARTITION BY project_id ORDER BY file_order, chapter_id) AS place FROM v",
    )
    register("chapter_detail", lambda s, d: paras(s, d).select("project_id", "chapter_id", "para_id", F.row_number().over(Window.partitionBy("project_id", "chapter_id").orderBy("para_index", "para_id")).cast("long").alias("place"), "original_text", "translated_text", "status", "tag"), f"WITH {LATEST} SELECT project_id, chapter_id, para_id, row_number() OVER (PARTITION BY project_id, chapter_id ORDER BY para_index, para_id) AS place, original_text, translated_text, status, tag FROM lp")
    register("chapter_title_search", lambda s, d: chaps(s, d).filter(F.lower("title").contains(F.lower(F.trim(F.lit("  The S "))))).select("project_id", "chapter_id", "title"), f"WITH {CHAPTERS} SELECT project_id, chapter_id, title FROM lc WHERE contains(lower(title), 'the s')")
    register("effective_text", lambda s, d: paras(s, d).select("row_id", T.effective(F.col("translated_text"), F.col("original_text")).alias("text")), f"WITH {LATEST} SELECT row_id, {eff()} AS text FROM lp")
    register("source_group", lambda s, d: B.group_by_source(paras(s, d), chaps(s, d)), f"WITH {LATEST}, {CHAPTERS} SELECT lp.project_id, coalesce(nullif(source_doc, ''), nullif(doc_name, ''), '') AS source, count(*) AS n_rows, count(*) FILTER ({DONE}) AS done_rows FROM lp LEFT JOIN lc USING (project_id, chapter_id) GROUP BY ALL")
    register("element_substitution", lambda s, d: B.substitutions(paras(s, d)), f"WITH {LATEST} SELECT project_id, source_doc, source_element_index, row_id, {eff()} AS text FROM lp WHERE source_element_index >= 0 AND coalesce(source_doc, '') <> '' QUALIFY row_number() OVER (PARTITION BY project_id, source_doc, source_element_index ORDER BY para_index, row_id) = 1")
    register(
        "duplicate_match", lambda s, d: B.duplicate_matches(_old(s, d), _elements(s, d)),
        f"WITH {LATEST}, {PROJECTS}, {OLD}, a AS (SELECT project_id, source_doc, row_id, {ssqueeze('original_text')} AS t, row_number() OVER (PARTITION BY project_id, source_doc, {ssqueeze('original_text')} ORDER BY para_index, row_id) AS n FROM od WHERE source_element_index < 0), b AS (SELECT em.*, row_number() OVER (PARTITION BY project_id, source_doc, t ORDER BY pos) AS n FROM em ANTI JOIN tk USING (project_id, source_doc, pos)) SELECT project_id, source_doc, row_id, pos FROM a JOIN b USING (project_id, source_doc, t, n)",
    )
    register(
        "caption_pairing", lambda s, d: B.caption_pairs(paras(s, d)),
        f"WITH {LATEST}, c AS (SELECT *, {IS_CAP} AS cap FROM lp), w AS (SELECT *, lead(cap) OVER x AS ncap, lead(para_id) OVER x AS nid, lag(tag) OVER x AS ptag FROM c WINDOW x AS (PARTITION BY project_id, chapter_id ORDER BY para_index, para_id)), k AS (SELECT *, CASE WHEN tag = 'img' AND ncap THEN 'captioned_image' WHEN tag = 'img' THEN 'image' WHEN cap AND ptag = 'img' THEN 'consumed' WHEN cap THEN 'caption' END AS kind FROM w) SELECT project_id, chapter_id, para_id, kind, CASE WHEN kind = 'captioned_image' THEN nid END AS caption_id, CASE WHEN kind = 'caption' THEN {IS_TAB} END AS is_table FROM k WHERE kind IS NOT NULL AND kind <> 'consumed'",
    )
    register(
        "caption_parts", lambda s, d: paras(s, d).filter("tag = 'caption'").select("row_id", F.trim(F.regexp_extract("original_text", "(?iu)" + T.CAPTION_LABEL, 1)).alias("label"), F.when(F.col("original_text").rlike("(?iu)" + T.CAPTION_LABEL), F.trim(F.regexp_extract("original_text", "(?iu)" + T.CAPTION_LABEL, 2))).otherwise(F.col("original_text")).alias("content")),
        f"WITH {LATEST} SELECT row_id, trim(regexp_extract(original_text, '(?i){T.CAPTION_LABEL}', 1)) AS label, CASE WHEN regexp_matches(original_text, '(?i){T.CAPTION_LABEL}') THEN trim(regexp_extract(original_text, '(?i){T.CAPTION_LABEL}', 2)) ELSE original_text END AS content FROM lp WHERE tag = 'caption'",
    )
    register("title_duplicates", lambda s, d: B.title_duplicates(paras(s, d), chaps(s, d)), f"WITH {LATEST}, {CHAPTERS}, {DUP} SELECT * FROM dp")
    register("paper_flag", lambda s, d: B.paper_flags(projs(s, d), chaps(s, d)), f"WITH {PROJECTS}, {CHAPTERS}, n AS (SELECT project_id, coalesce(bool_or(lower({sstrip('title')}) IN ('abstract', 'tóm tắt')), false) AS named, coalesce(bool_or(lower({sstrip('title')}) = 'phần mở đầu / tiêu đề'), false) AS opened FROM lc GROUP BY ALL) SELECT project_id, CASE WHEN coalesce(document_type, '') <> '' THEN document_type = 'paper' ELSE coalesce(named OR (source_format = 'pdf' AND opened), false) END AS is_paper FROM pj LEFT JOIN n USING (project_id)")
    register("output_title", _output_title, f"WITH {PROJECTS}, {LATEST}, {CHAPTERS}, {SAME} SELECT project_id, CASE WHEN coalesce(document_type = 'textbook' OR contains(lower(title), 'giáo trình') OR contains(lower(author), 'bộ giáo dục'), false) OR project_id IN (SELECT project_id FROM sm) THEN title ELSE title || ' (Bản Dịch Tiếng Việt)' END AS output_title, title || ' (Song Ngữ Anh - Việt)' AS bilingual_title FROM pj")
    vi = "length(coalesce(" + sstrip("translated_text") + ", '')) > 0"
    register("reader_view", lambda s, d: B.reader_view(paras(s, d)), f"""WITH {LATEST} SELECT project_id, chapter_id, para_id, CASE WHEN coalesce(regexp_matches(lower(tag), '^h[1-6]$'), false) THEN lower(tag) ELSE 'p' END AS element, coalesce(original_text, '') AS en_text, CASE WHEN {vi} THEN translated_text ELSE '[Chưa dịch: "' || substring(coalesce(original_text, ''), 1, 80) || '…"]' END AS vi_text, coalesce(original_text, '') || chr(10) || CASE WHEN {vi} THEN translated_text ELSE '[Đoạn này chưa dịch]' END AS bilingual_text FROM lp""")
    register("export_txt", lambda s, d: B.text_export(paras(s, d), chaps(s, d), projs(s, d), False), _txt_sql(False))
    register("export_bilingual_txt", lambda s, d: B.text_export(paras(s, d), chaps(s, d), projs(s, d), True), _txt_sql(True))
    shown = _escape_sql(eff(o="coalesce(original_text, '')"))
    register("export_html_fragments", lambda s, d: B.html_fragment(paras(s, d)), f"""WITH {LATEST}, t AS (SELECT *, {shown} AS shown, CASE WHEN lower(coalesce(tag, 'p')) IN ('h1','h2','h3','h4','h5','h6','blockquote','li') THEN lower(tag) ELSE 'p' END AS el FROM lp) SELECT project_id, chapter_id, para_id, CASE WHEN tag = 'img' THEN '<figure id="' || para_id || '"></figure>' WHEN tag = 'hr' THEN '<hr/>' WHEN {IS_CAP} THEN '<p class="caption">' || shown || '</p>' WHEN regexp_matches({sstrip(eff(o="coalesce(original_text, '')"))}, '^[∗†‡*]') THEN '<p class="footnote">' || shown || '</p>' ELSE '<' || el || '>' || shown || '</' || el || '>' END AS html FROM t""")
    register("tag_map", lambda s, d: paras(s, d).select("row_id", T.output_tag(F.coalesce("tag", F.lit("p"))).alias("tag")), f"WITH {LATEST} SELECT row_id, CASE WHEN tag IS NULL THEN 'p' ELSE {OUT_TAG} END AS tag FROM lp")
    markers = ", ".join(f"'{m}'" for m in T.SCENE_MARKERS)
    register("scene_breaks", lambda s, d: paras(s, d).filter(T.is_scene_break(F.col("tag"), F.col("original_text"))).select("row_id"), f"WITH {LATEST} SELECT row_id FROM lp WHERE coalesce(tag = 'hr', false) OR coalesce(original_text, '') IN ({markers}) OR regexp_matches(coalesce(original_text, ''), '{T.ORNAMENTS}')")
    register("math_unicode", lambda s, d: _formulas(s, d).select("row_id", T.math_unicode(F.col("t")).alias("html")), f"WITH {LATEST}, {FORMULAS} SELECT row_id, {_math_sql(False)} AS html FROM f")
    register("math_docx", lambda s, d: _formulas(s, d).select("row_id", T.math_docx(F.col("t")).alias("text")), f"WITH {LATEST}, {FORMULAS} SELECT row_id, {_math_sql(True)} AS text FROM f")
    register("math_name", lambda s, d: _formulas(s, d).select("row_id", F.concat(F.lit("math_"), F.substring(F.md5(F.concat("t", F.lit("_250"))), 1, 12)).alias("name")), f"WITH {LATEST}, {FORMULAS} SELECT row_id, 'math_' || substring(md5(t || '_250'), 1, 12) AS name FROM f")
    register("nfc_normalise", lambda s, d: table(s, d, "documents").select("doc_id", T.nfc("text").alias("text")), "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
    register("html_escape", lambda s, d: table(s, d, "documents").select("doc_id", T.html_escape(F.col("text")).alias("text")), f"SELECT doc_id, {_escape_sql('text')} AS text FROM documents")
    register("name_hits_union", lambda s, d: B.name_hits(_first(s, d)).groupBy("project_id").agg(F.count("*").alias("hits")), f"WITH {LATEST}, {CHAPTERS}, {HITS} SELECT project_id, sum(hits)::BIGINT AS hits FROM cn GROUP BY ALL")
    register("speaker_names", lambda s, d: B.speaker_names(_first(s, d)).drop("first_seen"), f"WITH {LATEST}, {CHAPTERS}, {HITS} SELECT project_id, name, hits FROM cn")
    register("speaker_names_topk", lambda s, d: B.top_speakers(B.speaker_names(_first(s, d)), _names_known(s)), f"WITH {LATEST}, {CHAPTERS}, {HITS} SELECT project_id, name, hits FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY hits DESC, seen) AS rn FROM cn) WHERE rn <= 12 AND hits >= 2 AND lower(name) NOT IN ('joossa', 'nemi')")
    register("chunk_pack", _pack(1000, 12), pack_sql(1000, 12))
    register("chunk_pack_small", _pack(100, 4), pack_sql(100, 4))
    register("chunk_context", lambda s, d: C.contexts(paras(s, d)).select("project_id", "chapter_id", "para_id", F.array_join("context", "\n").alias("context_text")), f"WITH {LATEST} SELECT project_id, chapter_id, para_id, coalesce(context_text, '') AS context_text FROM ({CTX})")
    register(
        "chunk_prompt", lambda s, d: C.prompt_body(C.greedy_chunks(B.chunk_candidates(paras(s, d), False)), paras(s, d)),
        pack_sql(1000, 12, "SELECT k.project_id, k.chapter_id, chunk_no, string_agg('[[[P_' || k.para_id || ']]]' || chr(10) || coalesce(original_text, ''), chr(10) || chr(10) ORDER BY k.para_index, k.para_id) AS prompt FROM packed k JOIN lp USING (project_id, chapter_id, para_id) GROUP BY ALL"),
    )
    register(
        "flagship_chunk_plan", _plan,
        pack_sql(1000, 12, f", ctx AS ({CTX}), pl AS (SELECT project_id, chapter_id, chunk_no, arg_min(para_id, rn) AS first_para, count(*) AS n_rows, sum(n_words)::BIGINT AS n_words FROM packed GROUP BY ALL) SELECT pl.project_id, pl.chapter_id, chunk_no, first_para, n_rows, n_words, coalesce(context_text, '') AS context_text FROM pl JOIN ctx ON pl.project_id = ctx.project_id AND pl.chapter_id = ctx.chapter_id AND pl.first_para = ctx.para_id"),
    )
    register("response_parse", _parsed, f"WITH {REPLIES}, {PARSED} SELECT project_id, chapter_id, chunk_id, para_id, text FROM pr WHERE text <> ''")
    register("translation_merge", _merge, f"WITH {LATEST}, {REPLIES}, {PARSED}, r AS (SELECT project_id, chapter_id, para_id, arg_max(text, chunk_id) AS reply FROM pr WHERE text <> '' GROUP BY ALL) SELECT project_id, chapter_id, para_id, coalesce(nullif(reply, ''), translated_text) AS translated_text, CASE WHEN nullif(reply, '') IS NOT NULL THEN 'done' ELSE status END AS status FROM lp LEFT JOIN r USING (project_id, chapter_id, para_id)")
    register("plain_heading_classify", _classify, _classify_sql())
    register("text_sections_permissive", _text_sections(False), _sections_sql(False))
    register("text_sections_strict", _text_sections(True), _sections_sql(True))
    register("markdown_sections", _markdown, MARKDOWN)
    register("page_text_paragraphs", _page_paragraphs, PAGE)
    register(
        "boilerplate_filter", lambda s, d: B.without_boilerplate(paras(s, d), chaps(s, d)).select("row_id"),
        f"WITH {LATEST}, {CHAPTERS} SELECT row_id FROM lp LEFT JOIN lc USING (project_id, chapter_id) WHERE NOT (coalesce(chapter_order = 0, false) AND ({LICENCE})) AND length({sstrip('original_text')}) > 0",
    )
