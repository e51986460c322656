"""Queries that SQL cannot express: decoding, models and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.math_html import math_html
from ..operators import books as B
from ..operators import chunks as C
from ..sinks import files as S
from ..session import shared_folder
from ..sources.html import explode_elements
from ..streaming import progress as P
from ..translate.run import StubTranslator, run_prompts
from . import fixtures as X
from .books import chaps, paras, projs
from .layouts import DISTINCT
from .registry import register


def _pages(s, d):
    """Chapters as HTML pages, made of their own rows."""
    html = B.html_fragment(paras(s, d)).join(paras(s, d).select(*B.PARA_KEY, "para_index"), B.PARA_KEY)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_index", "para_id", "html"))), lambda x: x["html"]), "\n")
    return html.groupBy("project_id", "chapter_id").agg(F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html")).withColumn("page_key", F.concat_ws("/", "project_id", "chapter_id"))


def _elements(s, d):
    return explode_elements(_pages(s, d), "page_key").select("page_key", "element_index", "tag", "text")


def _heading_sections(s, d):
    e = _elements(s, d)
    w = Window.partitionBy("page_key")
    e = e.withColumn("level", F.nullif(F.regexp_extract("tag", "^h([1-6])$", 1), F.lit("")).cast("int")).withColumn("top", F.min("level").over(w))
    start = F.coalesce(F.col("level") == F.col("top"), F.lit(False)).cast("int")
    return e.withColumn("section", F.sum(start).over(w.orderBy("element_index"))).groupBy("page_key", "section").agg(F.count("*").alias("elements"), F.min_by("text", "element_index").alias("title"))


def _stub_run(s, d):
    p = paras(s, d)
    prompts = C.prompt_body(C.greedy_chunks(B.chunk_candidates(p)), p)
    runs = run_prompts(prompts, ["project_id", "chapter_id", "chunk_no"], StubTranslator)
    return B.merged(p, C.parse_reply(["project_id", "chapter_id"], runs).withColumnRenamed("text", "reply"))


def _stream(s, d):
    """The events as a stream, run once into the shared folder, repeated deliveries dropped."""
    root = f"{shared_folder(s)}/feed_{uuid.uuid4().hex}"
    P.run_once(P.deduplicated(P.read_events(s, f"{d}/job_events.parquet")), f"{root}/out", f"{root}/offsets")
    return s.read.parquet(f"{root}/out").select("project_id", "chapter_id", "para_id", "level_name", "message", "event_at")


def register_all() -> None:
    register("html_leaf_elements", lambda s, d: explode_elements(X.HTML.df(s), "page_id"))
    register("html_chapter_elements", _elements)
    register("html_heading_sections", _heading_sections)
    register("math_html", lambda s, d: paras(s, d).filter(F.col("original_text").rlike(r"[\\$^=]")).select("row_id", math_html("original_text").alias("html")))
    register("translate_stub_run", _stub_run)
    register("event_feed_stream", _stream, f"WITH {DISTINCT} SELECT project_id, chapter_id, para_id, level_name, message, event_at FROM de")
    register("export_docx", lambda s, d: S.export_files(S.ordered_rows(paras(s, d), chaps(s, d), projs(s, d)), "docx").select("project_id", "file_name", F.length("content").alias("n_bytes")))
    register("export_epub", lambda s, d: S.export_files(S.ordered_rows(paras(s, d), chaps(s, d), projs(s, d)), "epub").select("project_id", "file_name", F.length("content").alias("n_bytes")))
