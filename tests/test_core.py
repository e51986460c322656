"""Operators against small fixtures, with nulls, empties, ties and repeated rows."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import math_html, rules
from folioflow.functions import text as T
from folioflow.operators import books as B
from folioflow.operators import chunks as C
from folioflow.operators import events as E
from folioflow.operators import glossary as G
from folioflow.operators import layout as L
from folioflow.operators import toc as O
from folioflow.plans import fixtures as X
from folioflow.plans import registry
from folioflow.sinks import files as S
from folioflow.sources import files as SF
from folioflow.sources.html import leaf_elements
from folioflow.streaming import progress as P
from folioflow.translate.ratelimit import JobState, KeyPool
from folioflow.translate.run import StubTranslator, failed, run_prompts

PARA = "row_id long, project_id string, chapter_id string, para_id string, original_text string, translated_text string, status string, tag string, para_index int, source_doc string, source_element_index int, loaded_at timestamp"
T0 = dt.datetime(2025, 1, 1)


def para(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = {"row_id": i, "project_id": "p", "chapter_id": "chap_0", "para_id": f"x{i:03d}", "original_text": "a b", "translated_text": "", "status": "pending", "tag": "p", "para_index": i, "source_doc": "", "source_element_index": -1, "loaded_at": T0} | r
        full.append(tuple(d[c.split()[0]] for c in PARA.split(", ")))
    return spark.createDataFrame(full, PARA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_latest_takes_last_delivery_and_breaks_ties_by_row(spark):
    df = para(spark, [{"para_id": "a", "status": "done"}, {"para_id": "a", "status": "error", "loaded_at": T0 + dt.timedelta(1)}, {"para_id": "b", "status": None}, {"para_id": "b", "status": "done"}])
    got = {r.para_id: r.status for r in B.current_paragraphs(df).collect()}
    assert got == {"a": "error", "b": "done"}


def test_progress_rounds_half_to_even_and_handles_nulls(spark):
    df = para(spark, [{"status": "done"}] + [{"status": None, "original_text": None}] * 15)
    r = B.chapter_progress(df).collect()[0]
    assert (r.total_rows, r.done_rows, r.progress, r.n_words, r.badge) == (16, 1, 6.2, 2, "progress")
    assert B.chapter_progress(df.limit(0)).count() == 0


@pytest.mark.parametrize("target,most,block", [(10, 3, 4096), (10, 3, 5), (1000, 12, 4096), (1000, 12, 7), (60, 12, 2), (1, 1, 4)])
def test_packing_equals_a_plain_loop(spark, target, most, block):
    rnd = random.Random(7)
    sizes = [rnd.choice([0, 1, 2, 3, 9, 10, 11, 40]) for _ in range(200)]
    df = para(spark, [{"original_text": " ".join(["w"] * n) if n else None, "chapter_id": f"chap_{i % 3}"} for i, n in enumerate(sizes)])
    got = {r.para_id: r.chunk_no for r in C.greedy_chunks(df, target, most, block).collect()}
    for c in range(3):
        words = n = chunk = 0
        for i in range(c, 200, 3):
            if n and (words + sizes[i] > target or n >= most):
                words, n, chunk = 0, 0, chunk + 1
            words, n = words + sizes[i], n + 1
            assert got[f"x{i:03d}"] == chunk


def test_context_is_what_stands_right_before(spark):
    df = para(spark, [{"original_text": f"o{i}", "translated_text": " t1 " if i == 1 else None} for i in range(5)])
    got = {r.para_id: r.context for r in C.contexts(df).collect()}
    assert got["x000"] == [] and got["x004"] == ["t1", "o2", "o3"]


def test_replies_markers_positions_and_unknown_ids(spark):
    got = {(r.chunk_id, r.para_id): (r.text, r.method) for r in C.resolved_replies(["chunk_id"], X.REPLIES.df(spark), X.EXPECTED.df(spark)).collect()}
    assert got[("c1", "b")] == ("Hai", "marker")
    assert got[("c3", "a")] == ("Một", "position") and ("c4", "a") not in got
    assert got[("c5", "a")] == ("Một mới", "marker") and ("c5", "b") not in got
    assert got[("c6", "a")] == ("Một", "marker") and ("c6", "x") not in got and not any(k[0] == "c7" for k in got)


def test_merge_keeps_rows_without_a_reply(spark):
    df = para(spark, [{"translated_text": "cũ", "status": "error"}, {"translated_text": None, "status": None}])
    replies = spark.createDataFrame([("p", "chap_0", "x000", "  "), ("p", "chap_0", "x001", " mới ")], "project_id string, chapter_id string, para_id string, reply string")
    got = {r.para_id: (r.translated_text, r.status) for r in B.merged(df, replies).collect()}
    assert got == {"x000": ("cũ", "error"), "x001": ("mới", "done")}


def test_captions_pair_with_the_image_before(spark):
    df = para(spark, [{"tag": "img"}, {"tag": "caption", "original_text": "Figure 1. A"}, {"tag": "img"}, {"original_text": "Bảng 2: b"}, {"tag": "img"}, {"tag": None, "original_text": None}])
    got = {r.para_id: (r.kind, r.caption_id, r.is_table) for r in B.caption_pairs(df).collect()}
    assert got == {"x000": ("captioned_image", "x001", None), "x002": ("captioned_image", "x003", None), "x004": ("image", None, None)}


def test_licence_phrases_go_only_in_the_first_chapter(spark):
    text = "Permission to make digital or hard copies of this work"
    df = para(spark, [{"original_text": text}, {"original_text": text, "chapter_id": "chap_1"}, {"original_text": None}, {"original_text": "x"}])
    chapters = spark.createDataFrame([("p", "chap_0", 0), ("p", "chap_1", 1)], "project_id string, chapter_id string, chapter_order int")
    assert sorted(r.row_id for r in B.without_boilerplate(df, chapters).collect()) == [1, 3]


HEADINGS = [("1 Introduction", 1), ("2.1 Methods", 2), ("Abstract", 1), ("Chapter 3", 1), ("IV Results", 1), ("The map was old.", None), ("Introduction ..... 3", None), ("1. They walked on and on, and the rain did not stop until the evening came.", None), ("", None), ("x", None), (None, None)]


def test_plain_headings(spark):
    df = spark.createDataFrame(HEADINGS, "t string, want int")
    assert all(r.want == r.got for r in df.withColumn("got", T.heading_level(F.col("t"))).collect())


def test_math_keeps_the_order_of_replacement(spark):
    df = spark.createDataFrame([(r"\infty \frac{a}{b} x_{ij}^2",)], "t string")
    assert df.select(T.math_unicode(F.col("t"))).collect()[0][0] == '<span class="math-fallback">∈fty (a / b) x<sub>ij</sub><sup>2</sup></span>'
    assert math_html.format_math("costs $5$ and $x_1$, $$E\\tag{3}$$") == 'costs $5$ and <span class="formula">x<sub>1</sub></span>, <div class="equation">E<span class="number">(3)</span></div>'
    assert math_html.format_math(None) is None


def test_columns_are_read_left_before_right_within_bands(spark):
    got = {(r.page, r.block_no): r.place for r in L.reading_order(X.BLOCKS.df(spark)).collect()}
    assert [b for _, b in sorted((got[0, b], b) for b in range(7))] == [0, 1, 3, 2, 4, 6, 5]


def test_elements_belong_to_the_last_start(spark):
    spine = O.reading_spine(X.SPINE.df(spark))
    starts = O.anchored(O.resolved(O.promoted(X.TOC.df(spark)), spine), spine, X.ELEMENTS.df(spark))
    got = {(r.doc_id, r.spine_idx, r.el_pos): r.chapter for r in O.assigned(starts, spine, X.ELEMENTS.df(spark)).collect()}
    assert got["b1", 2, 0] == "Chapter 1" and got["b1", 2, 2] == "Chapter 2" and got["b1", 4, 0] == "Notes" and got["b2", 0, 0] == "Preamble" and got["b2", 0, 1] == "Deep"


def test_chapters_below_many_grouping_nodes_are_kept(spark):
    nested = [("b", i, i - 1 if i else None, i, f"Part {i}", "", "") for i in range(19)] + [("b", 19, 18, 19, "Deep", "x.html", "f"), ("b", 20, 5, 6, "Middle", "y.html", "")]
    toc = spark.createDataFrame(nested, "doc_id string, toc_pos int, parent_pos int, depth int, title string, path string, fragment string")
    assert sorted(r.title for r in O.promoted(toc).collect()) == ["Deep", "Middle"]
    assert O.promoted(toc.limit(0)).count() == 0


def test_glossary_keeps_the_first_place_and_the_last_entry(spark):
    got = {(r.project_id, r.key): (r.place, r.name, r.role) for r in G.resolved_characters(X.CHARACTERS.df(spark)).collect()}
    assert got["p1", "anna"] == (0, "ANNA", "queen")


def test_repeated_events_count_once_and_late_ones_stay(spark):
    ev = "event_id long, project_id string, chapter_id string, para_id string, level_name string, message string, event_at timestamp, received_at timestamp"
    late = T0 + dt.timedelta(3)
    df = spark.createDataFrame([(1, "p", "c", None, None, "m", T0, T0), (2, "p", "c", None, None, "m", T0, late), (3, "p", "c", "a", "error", "n", T0, late)], ev)
    once = E.distinct_events(df)
    assert sorted(r.event_id for r in once.collect()) == [1, 3]
    assert [r.event_id for r in E.feed_since(once, "2025-01-02 00:00:00").collect()] == [3]
    assert [r.event_id for r in E.late_events(once).collect()] == [3]


def test_the_event_stream_keeps_old_events_of_later_batches(spark, tmp_path):
    ev = "event_id long, project_id string, chapter_id string, para_id string, level_name string, message string, event_at timestamp_ntz, received_at timestamp_ntz"
    new = T0 + dt.timedelta(300)
    files = [[(1, new)], [(2, T0)], [(3, new), (4, T0 + dt.timedelta(1))], [(5, T0), (6, T0 + dt.timedelta(2))]]
    for i, f in enumerate(files):  # newest first; a batch each
        folder = tmp_path / f"w{i}"
        spark.createDataFrame([(e, "p", "c", None, None, "m", at, at) for e, at in f], ev).coalesce(1).write.parquet(str(folder))
        (tmp_path / "job_events.parquet").mkdir(exist_ok=True)
        target = tmp_path / "job_events.parquet" / f"{i}.parquet"
        next(folder.glob("*.parquet")).rename(target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = P.deduplicated(P.read_events(spark, str(tmp_path / "job_events.parquet"), files_per_trigger=1))
    P.run_once(stream, str(tmp_path / "out"), str(tmp_path / "offsets"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4, 6]


def test_leaf_elements_wrap_loose_text_and_keep_ordinals():
    got = [(i, t, x) for i, t, x, _, _ in leaf_elements("<div>loose <i>text</i><p>inner</p>tail</div><p></p><hr/><ul><li>a</li><li><p>b</p></li></ul><p>one<p>two")]
    assert got == [(0, "p", "loose text"), (1, "p", "inner"), (2, "p", "tail"), (4, "hr", ""), (5, "li", "a"), (6, "p", "b"), (7, "p", "one"), (8, "p", "two")]
    assert leaf_elements(None) == []


def test_epub_and_docx_survive_a_round_trip():
    data = S.epub_bytes("Title & more", "A. Author", [("One", [("h1", "One"), ("p", "first <line>")]), ("Two", [("p", "second")])])
    parts = SF.epub_parts(data)
    assert (parts["title"], parts["author"]) == ("Title & more", "A. Author")
    assert [e[3] for e in parts["elements"]] == ["One", "first <line>", "Two", "second"]
    assert [t[3] for t in parts["toc"]] == ["One", "Two"] and all(p for p, _, _ in parts["spine"])
    changed = S.rewrite_epub(data, {("OEBPS/text/ch0000.xhtml", 1): "dòng đầu"})
    assert [e[3] for e in SF.epub_parts(changed)["elements"]] == ["One", "dòng đầu", "Two", "second"]
    doc = S.docx_bytes("Book", [("h1", "One"), ("p", "text"), ("blockquote", "q")])
    assert [(s, t) for _, _, s, t in SF.docx_rows(doc)] == [("title", "Book"), ("heading 1", "One"), ("normal", "text"), ("quote", "q")]


def test_files_that_cannot_be_decoded_give_an_error_row(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\x0btwo\n\nthree")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.epub").write_bytes(S.epub_bytes("T", "A", [("C", [("p", "x")])]))
    got = SF.read_books(spark, str(tmp_path)).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.pos) if r.kind == "txt"] == ["one", "two", "", "three"]
    assert [bool(r.error) for r in got if r.kind == "docx"] == [True]
    assert {r.tag for r in got if r.kind == "epub"} >= {"p", "spine", "toc"}


def test_ocr_takes_only_missing_pages_and_gives_up(spark):
    pages = spark.createDataFrame([("p", 1, b"ok"), ("p", 2, b"bad"), ("p", 3, b"ok")], "project_id string, page int, image binary")
    cache = spark.createDataFrame([("p", 3)], "project_id string, page int")

    def read(image):
        if image == b"bad":
            raise ValueError("unreadable")
        return "text"

    got = {r.page: (r.text, r.error) for r in SF.ocr_pages(pages, cache, read).collect()}
    assert got == {1: ("text", None), 2: (None, "unreadable")}


def test_missing_pages_reach_the_end_of_the_book(spark):
    pages = spark.createDataFrame([("p", i, "x" if i % 2 else " ") for i in range(500)] + [("q", 0, None), ("q", 0, None), ("q", 1, "x"), ("q", None, None)], "project_id string, page int, translated_text string")
    assert sorted(rows(B.missing_pages(pages))) == [("p", i) for i in range(0, 500, 2)] + [("q", 0)]
    assert sorted(rows(B.missing_pages(pages, 398, 9999))) == [("p", i) for i in range(398, 500, 2)]
    assert sorted(rows(B.missing_pages(pages, -5, 2))) == [("p", 0), ("p", 2), ("q", 0)]
    assert rows(B.missing_pages(pages, 600)) == []


def test_missing_pages_query_counts_pages_after_400(spark, tmp_path):
    para(spark, [{"para_index": i + 1} for i in range(450)]).write.parquet(str(tmp_path / "paragraphs.parquet"))
    spark.createDataFrame([("p", "pdf", T0)], "project_id string, source_format string, loaded_at timestamp").write.parquet(str(tmp_path / "projects.parquet"))
    assert sorted(r.page for r in registry.queries()["ocr_missing_pages"](spark, str(tmp_path)).collect()) == list(range(450))


def test_translator_runs_retry_and_keep_failures(spark):
    class Flaky(StubTranslator):
        def __init__(self):
            self.n = 0

        def translate(self, prompt):
            self.n += 1
            if "never" in prompt or self.n == 1:
                raise RuntimeError("down")
            return super().translate(prompt)

    df = spark.createDataFrame([(1, "[[[P_a]]]\nhello"), (2, "[[[P_b]]]\nnever")], "k int, prompt string").coalesce(1)
    runs = run_prompts(df, ["k"], Flaky)
    assert {r.k: (r.reply, r.calls) for r in runs.collect()} == {1: ("[[[P_a]]]\nvi: hello", 2), 2: (None, 4)}
    assert [r.k for r in failed(runs).collect()] == [2]


def test_key_pool_paces_rotates_and_retires():
    now = [0.0]
    pool = KeyPool(["a", "b", "a"], 3.5, clock=lambda: now[0])
    assert pool.lease()[0] == "a" and pool.lease()[0] == "b" and pool.lease() == (None, 3.5)
    pool.release("a", daily=True)
    pool.release("b", cooldown=10)
    assert pool.lease() == (None, 10.0)
    now[0] = 10.0
    assert pool.lease()[0] == "b"


def test_job_state_refuses_a_second_start():
    s = JobState()
    assert s.on("start") and not s.on("start") and s.on("stop") and s.on("finish") and s.state == "idle"


def test_versions_switch_by_pointer(spark, tmp_path):
    assert S.append_version(spark.range(3), str(tmp_path), 0) == 1
    df, seen = S.current_version(spark, str(tmp_path))
    assert (df.count(), seen) == (3, 1) and S.append_version(spark.range(5), str(tmp_path), seen) == 2
    with pytest.raises(ValueError):  # another writer was faster
        S.append_version(spark.range(9), str(tmp_path), seen)
    assert S.current_version(spark, str(tmp_path))[0].count() == 5
    with pytest.raises(ValueError):
        S.without_project(spark.createDataFrame([("p",)], "project_id string"), "p", {"p"})


def test_rules(spark):
    df = X.UPLOADS.df(spark).select("file_name", rules.upload_verdict(F.col("file_name"), F.col("n_bytes"), F.col("document_type")).alias("v"))
    got = dict(rows(df))
    assert got["a.epub"] == "accepted" and got["c.pdf"] == "incompatible" and got["../h.txt"] == "bad_name" and got["j.PDF"] == "accepted"


def test_binaries_reach_a_folder_by_rename(spark, tmp_path):
    files = spark.createDataFrame([("a.bin", bytearray(b"one")), ("b.bin", bytearray(b"two"))], "file_name string, content binary")
    assert sorted(r.file_name for r in S.write_binary(files, str(tmp_path / "out")).collect()) == ["a.bin", "b.bin"]
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()} == {"a.bin": b"one", "b.bin": b"two"}


def test_a_stopped_run_goes_on_with_the_next_batch(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []

    def run(stopped):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return P.commit_batches(stream, lambda b, n: got.append([r.id for r in b.collect()]), str(tmp_path / "ck"), stopped)

    assert run(lambda: len(got) >= 1) is False and len(got) == 1
    assert run(lambda: False) is True
    assert sorted(x for b in got for x in b) == list(range(30))


def test_headings_by_place_name_and_outline(spark):
    got = {(r.doc, r.page, r.line_no): r.level for r in L.heading_levels(X.SPANS.df(spark), X.OUTLINE.df(spark), X.PAGE_SIZES.df(spark)).collect()}
    assert got["d3", 3, 1] in (1, 2)  # the text of a running header in the body is a heading
    assert [got["d3", k, 0] for k in range(3)] == [0, 0, 0] and got["d3", 3, 3] == 1
    running = {tuple(r) for r in L.running_lines(X.SPANS.df(spark), X.PAGE_SIZES.df(spark)).collect()}
    assert {("d3", k, n) for k in range(3) for n in (0, 9)} <= running and ("d3", 3, 1) not in running and ("d3", 0, 3) not in running


def test_blocks_that_are_no_text(spark):
    left = {(r.doc, r.page, r.block_no) for r in L.noise_blocks(X.BLOCKS.df(spark), L.margin_texts(X.SPANS.df(spark), 2, X.PAGE_SIZES.df(spark)), X.PAGE_SIZES.df(spark)).collect()}
    gone = {("d1", 1, 2), ("d1", 1, 3), ("d1", 0, 7), ("d1", 1, 4), ("d3", 1, 0)}
    assert not gone & left and {("d1", 1, 5), ("d3", 3, 1), ("d1", 1, 6)} <= left


def test_rules_of_providers(spark):
    rows = [("gemini", "", "Quota: GenerateRequestsPerDay", None), ("gemini", "gemini-1.5-pro", "retry in 12.7 s", None), ("openai", "", "429", "7"), ("x", "", "perday", None), ("gemini", "m", "", None)]
    df = spark.createDataFrame(rows, "p string, m string, e string, h string")
    got = df.select(rules.error_class(F.col("e")), rules.retry_after(F.col("p"), F.col("e"), F.col("h")), rules.model_of(F.col("p"), F.col("m"))).collect()
    assert [r[0] for r in got] == ["daily", "other", "rate", "daily", "none"]
    assert [r[1] for r in got] == [35.0, 14.7, 9.0, 25.0, 35.0]
    assert [r[2] for r in got] == ["gemini-3.5-flash", "gemini-3.1-pro-preview", "gpt-4o-mini", "free-fallback", "m"]
    assert {r.account: r.status for r in rules.key_status(X.PROBES.df(spark)).collect()} == {"a": "ok", "b": "daily", "c": "rpm", "d": "ok", "e": "error", "f": "error", "g": "rpm"}


def test_references_of_packages_are_decoded(spark):
    rows = ["B%C3%BCcher/a%2Bb+c.xhtml#s%20t", "text/../img/b.png", "..\\c%20d.xhtml", "#only", "bad%zz.xhtml"]
    got = {r.href: (r.path, r.fragment) for r in O.href_parts(spark.createDataFrame([(h,) for h in rows], "href string")).collect()}
    assert [got[h] for h in rows] == [("Bücher/a+b+c.xhtml", "s t"), ("img/b.png", ""), ("../c d.xhtml", ""), ("", "only"), ("bad%zz.xhtml", "")]


def test_names_of_first_chapters_tie_by_first_seen(spark):
    chapters = spark.createDataFrame([("p", f"c{i}", i) for i in range(10)], "project_id string, chapter_id string, chapter_order int")
    text = ["said Zoe. said Adam. said Zoe. said Adam."] + ["x"] * 7 + ["said Late. said Late. said Late."] * 2
    paras = spark.createDataFrame([("p", f"c{i}", i, i, t) for i, t in enumerate(text)], "project_id string, chapter_id string, para_index int, row_id int, original_text string")
    names = B.speaker_names(B.first_chapters(paras, chapters))
    assert {r.name for r in names.collect()} == {"Zoe", "Adam"}
    assert [r.name for r in B.top_speakers(names, spark.createDataFrame([], "name string"), k=1).collect()] == ["Zoe"]


def test_texts_equal_in_the_first_rows_keep_their_title(spark):
    chapters = spark.createDataFrame([("a", "c0", 0), ("b", "c0", 0), ("b", "c1", 1)], "project_id string, chapter_id string, chapter_order int")
    rows = [("a", "c0", "p0", 0, "x", "x"), ("a", "c0", "p1", 1, "y", None), ("b", "c0", "p0", 0, "x", "ix"), ("b", "c1", "p0", 0, "x", "x")]
    paras = spark.createDataFrame(rows, "project_id string, chapter_id string, para_id string, para_index int, original_text string, translated_text string")
    same = B.given_in_translation(paras, chapters)
    assert [r.project_id for r in same.collect()] == ["a"]
    projects = spark.createDataFrame([("a", "T", "x", "novel"), ("b", "T", "x", "novel")], "project_id string, title string, author string, document_type string")
    assert {r.project_id: r.output_title for r in B.output_titles(projects, same).collect()} == {"a": "T", "b": "T (Bản Dịch Tiếng Việt)"}
